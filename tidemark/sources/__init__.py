"""Readers, writers and connectors, and the adapters that give tables their expected shapes."""
