"""Streaming of the retrieval pipeline."""
