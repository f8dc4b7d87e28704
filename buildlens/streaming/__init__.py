"""Structured Streaming twins of the batch ingestion."""
