"""Readers, writers and graphs derived from tables."""
