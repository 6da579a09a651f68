"""Queries of the library, registered by name as their modules load."""

from . import aggregates, analytics, enrichment, functions, generators, joins, landing, profiles, search, selections, windows  # noqa: F401
