"""Registered queries: each operator on the given tables, beside its SQL where SQL can say it."""

from __future__ import annotations

from panelcast.catalog import cleaning, forecasts, frames, joins, learned, resampling, scores, sources, streams, wide
from panelcast.catalog.registry import REGISTRY, SQL

__all__ = [
    "REGISTRY",
    "SQL",
    "cleaning",
    "forecasts",
    "frames",
    "joins",
    "learned",
    "resampling",
    "scores",
    "sources",
    "streams",
    "wide",
]
