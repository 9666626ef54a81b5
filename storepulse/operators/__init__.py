"""Operators: cleaning rules, profiling, column rewrites, sampling, generic relational ops."""
