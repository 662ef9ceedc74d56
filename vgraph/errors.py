"""What may go wrong, by name."""

from __future__ import annotations


class GraphError(Exception):
    """The base of this package's own errors."""


class BadGraph(GraphError, ValueError):
    """Files or tables that do not describe a graph."""


class NotConverged(GraphError):
    """Rounds were used up while vertices were still active."""
