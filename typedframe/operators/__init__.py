"""Mutations, transactions and derived lookups."""
