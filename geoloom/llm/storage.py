"""Tables of the run folder, as the rest of the library writes them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..storage import discard, exists, materialize, run_dir, shared_dir

__all__ = ["discard", "exists", "materialize", "new_path", "run_dir", "shared_dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for ``name`` in the run folder."""
    import uuid

    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
