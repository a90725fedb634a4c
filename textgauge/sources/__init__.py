"""Readers, writers and table upkeep."""
