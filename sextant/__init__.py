"""Sextant: screening and portfolio analytics for long price histories on Spark."""
