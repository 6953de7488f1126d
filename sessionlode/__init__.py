"""Session-history retrieval on Spark: chunking, full-text and vector search, rank fusion and incremental indexing."""

__version__ = "0.1.0"
