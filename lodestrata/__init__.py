"""A document-index and retrieval engine written as PySpark DataFrame jobs."""
