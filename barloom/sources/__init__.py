"""Readers, writers, schemas and views."""
