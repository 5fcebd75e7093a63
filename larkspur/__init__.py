"""Spark-first document-retrieval analytics: every stage is a DataFrame to DataFrame function."""
