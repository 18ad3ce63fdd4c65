"""Operators on long tables of series; every one takes and returns DataFrames."""
