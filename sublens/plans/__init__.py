"""Query registry and the DuckDB oracle."""
