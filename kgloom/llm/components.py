"""Connected components of an edge table; the graph operator, in the same written rounds."""

from ..operators.graph import connected_components

__all__ = ["connected_components"]
