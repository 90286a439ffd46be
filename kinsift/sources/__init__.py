"""Readers, writers, schemas and the scratch area."""
