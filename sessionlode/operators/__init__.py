"""Relational operators: chunking, full-text and vector retrieval, fusion, window reads, summaries."""
