"""Structured Streaming forms of the append and upsert jobs."""
