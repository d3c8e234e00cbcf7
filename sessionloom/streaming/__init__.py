"""Structured Streaming forms of the gates and of ingestion."""
