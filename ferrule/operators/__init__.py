"""Relational operators of the diagnostics dataflow."""
