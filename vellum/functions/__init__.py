"""Scalar functions: pure-Python scanners and Column expressions."""
