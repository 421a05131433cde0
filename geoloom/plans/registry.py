"""All registered queries of the spatial engine and their SQL."""

from __future__ import annotations

from . import raster_queries, shape_queries, vector_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
