"""Whole runs composed of operators, and the panels made of the warehouse tables."""
