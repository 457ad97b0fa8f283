"""Operators on tables of documents, chunks, folders and events."""
