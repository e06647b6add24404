"""Compositions of operators, and the tables they run on."""
