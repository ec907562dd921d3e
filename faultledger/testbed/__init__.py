"""The engine on the given star-schema tables: extracts, registered queries, oracle SQL."""
