"""Readers, writers and adapters to the canonical fact table."""
