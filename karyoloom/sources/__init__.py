"""Readers, writers and file catalogues."""
