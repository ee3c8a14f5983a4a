"""Structured Streaming: exactly-once incremental loading of the landing CSV files."""
