"""Document ingestion and graph-plus-vector retrieval analytics on PySpark."""
