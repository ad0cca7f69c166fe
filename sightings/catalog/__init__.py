"""Every inventory id as a runnable query with, where SQL can express it, its check."""

from __future__ import annotations

from sightings.catalog.registry import ORACLES, QUERIES
from sightings.catalog import (  # noqa: F401  (imports register the queries)
    sources_and_layouts,
    filters,
    places,
    joins,
    counts,
    search,
    scalars,
    standardising,
    exporting,
    changes,
    indexed,
)

__all__ = ["ORACLES", "QUERIES"]
