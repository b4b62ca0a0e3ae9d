"""The input views as stored keyed tables.

The record jobs work on tables that exist before a batch of requests comes in.  Each
view is stored once per application below the checkpoint folder; a query that changes
rows does so in a clone, which shares the base folders and copies no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.plans import views as V
from tidemark.session import scratch_path
from tidemark.sources import files, versions
from tidemark.sources.keyed import KeyedTable

_PATHS: dict[tuple[str, ...], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    known = (spark.sparkContext.applicationId, sf_dir, name)
    if known not in _PATHS or versions.latest(spark, _PATHS[known]) is None:  # scratch may have been removed
        path = scratch_path(spark, f"stored_{name}")
        make(path)
        _PATHS[known] = path
    return _PATHS[known]


def keyed(spark: SparkSession, sf_dir: str, view: str, key: str, **added: Column) -> KeyedTable:
    """View ``view`` as a keyed table with the columns ``added``."""
    path = _once(spark, sf_dir, view, lambda to: KeyedTable.create(spark, to, getattr(V, view)(spark, sf_dir).withColumns(added), key))
    return KeyedTable(spark, path, key)


def changed_copy(spark: SparkSession, sf_dir: str, view: str, key: str, **added: Column) -> KeyedTable:
    """A clone of ``keyed``, to be changed."""
    return keyed(spark, sf_dir, view, key, **added).clone(scratch_path(spark, f"changed_{view}"))


def index(spark: SparkSession, sf_dir: str, view: str, key: str, order: list[Column]) -> DataFrame:
    """View ``view`` as a stored index on ``key`` (``files.publish_index``)."""
    path = _once(spark, sf_dir, f"{view}_by_{key}", lambda to: files.publish_index(getattr(V, view)(spark, sf_dir), to, key, order))
    return files.read_snapshot(spark, path)
