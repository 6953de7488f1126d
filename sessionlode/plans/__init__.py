"""Whole plans: the index and its upkeep, hybrid search, the read tools, and the registered queries."""
