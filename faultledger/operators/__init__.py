"""DataFrame -> DataFrame steps of the ingestion."""
