"""Catalogue of named queries, their oracles, and staging of intermediate tables."""
