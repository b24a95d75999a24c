"""Expressions, predicates and functions."""
