"""Schemas, readers, writers and the mapping from the order tables."""
