"""Where data comes from: history tables, adapters, embedders, configuration."""
