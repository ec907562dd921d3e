"""Structured Streaming forms of the ingestion and of the weekly totals."""
