"""Indexing of changing source trees by Structured Streaming."""
