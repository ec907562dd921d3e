"""Readers of extracts and of the fact table."""
