"""Scalar trip operators: Column expressions and the same logic as SQL functions."""
