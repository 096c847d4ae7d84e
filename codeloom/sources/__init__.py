"""Readers of the stored tables."""

from codeloom.sources.tables import current_rows, graph_edges, graph_nodes, table

__all__ = ["current_rows", "graph_edges", "graph_nodes", "table"]
