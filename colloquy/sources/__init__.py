"""Readers, writers and driver configuration."""
