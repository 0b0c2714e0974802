"""Micro-batch ingestion; an extension, as the compared system has no stream processor."""
