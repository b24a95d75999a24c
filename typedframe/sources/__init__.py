"""Table declarations, data sources and schema policies."""
