from grovespark.sources.tables import current_files, current_nodes, distinct_edges, read, spread

__all__ = ["current_files", "current_nodes", "distinct_edges", "read", "spread"]
