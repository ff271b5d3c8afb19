"""Readers, writers, schemas and the case fixture."""
