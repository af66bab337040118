"""Readers, writers and the versioned snapshot tables."""
