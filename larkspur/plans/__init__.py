"""Plans of the retrieval pipeline."""
