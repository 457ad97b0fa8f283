"""Streaming ingestion, lifecycle state and incremental maintenance."""
