"""Stored tables, the ingestion run, and the views on the fact table."""
