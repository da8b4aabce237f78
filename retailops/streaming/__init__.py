"""Incremental variants of batch operators over Structured Streaming file sources."""
