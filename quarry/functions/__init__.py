"""Scalar functions with Presto semantics, as column expressions."""
