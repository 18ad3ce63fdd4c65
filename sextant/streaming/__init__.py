"""Incremental loading of price files."""
