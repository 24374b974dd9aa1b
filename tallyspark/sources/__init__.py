"""Readers, writers and the adapters for the given tables."""
