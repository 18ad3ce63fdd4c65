"""Readers of price series, symbol lists and stored artifacts."""
