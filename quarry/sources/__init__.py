"""Readers, writers and type signatures."""
