"""A small storage-neutral query algebra with two backends, on the graph plane and on tables."""

from .nodes import Compare, Count, Filter, FilterIn, FilterRange, Find, Limit, Offset, Project, Sort
from .run import QueryContext, run, validate

__all__ = ["Compare", "Count", "Filter", "FilterIn", "FilterRange", "Find", "Limit", "Offset", "Project", "QueryContext", "Sort", "run", "validate"]
