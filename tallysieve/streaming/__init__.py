"""Structured Streaming pipelines: ingest, change feed, digest and event windows."""
