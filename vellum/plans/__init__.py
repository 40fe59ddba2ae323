"""Compilers from query descriptions to Column expressions."""
