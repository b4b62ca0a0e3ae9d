"""Tables published by partition, and aggregates kept per partition.

A full recompute writes every partition again.  Here a partition whose rows are the same
as in the version before keeps its old folder (``publish_parts``), so the difference of
two versions says which partitions changed, and an aggregate that is made partition by
partition (``refresh``) is made anew for these alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import files, versions
from tidemark.sources.versions import Version


def _parts_of(spark: SparkSession, attempt: str) -> DataFrame:
    """The partitions of a written folder: part (``year=2026/month=1``) and seal, a
    checksum of its rows in any order."""
    rows = spark.read.parquet(attempt)
    part = F.regexp_extract(F.col("_metadata.file_path"), rf"/{attempt.rsplit('/', 1)[1]}/(.*)/[^/]+$", 1)
    digest = F.xxhash64(*rows.columns)
    sealed = rows.select(part.alias("part"), digest.alias("h")).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return sealed.select("part", F.concat_ws(":", "n", "x", "s").alias("seal"))


def publish_parts(df: DataFrame, path: str, partition_cols: tuple[str, ...], dealt: bool = False, **info) -> Version:
    """Publish a full recompute of a partitioned table.  Partitions with the same rows as
    before stay where they are; those that have no rows any more are left out.  ``dealt``
    as in ``files.write_attempt``."""
    spark = df.sparkSession
    before = versions.latest(spark, path)
    known = before.body["parts"] if before else {}
    attempt = files.write_attempt(df, path, partition_cols, dealt)
    parts, spare = {}, []
    for r in _parts_of(spark, attempt).collect():  # a row per partition
        same = known.get(r["part"], {}).get("seal") == r["seal"]
        parts[r["part"]] = known[r["part"]] if same else {"folder": f"{attempt}/{r['part']}", "seal": r["seal"]}
        if same:
            spare.append(f"{attempt}/{r['part']}")
    made = versions.commit(spark, path, sorted(p["folder"] for p in parts.values()), parts=parts, **info)
    files.delete_folders(spark, spare)  # no version names them
    return made


def read_parts(spark: SparkSession, version: Version, parts: list[str] | None = None) -> DataFrame | None:
    """The rows of a version of ``publish_parts``, of all partitions or of those named;
    None where there is none."""
    bases: dict[str, list[str]] = {}
    for part, held in version.body["parts"].items():
        if parts is None or part in parts:
            bases.setdefault(held["folder"][:-len(part) - 1], []).append(held["folder"])
    frames = [spark.read.option("basePath", base).parquet(*folders) for base, folders in sorted(bases.items())]
    return functools.reduce(lambda a, b: a.unionByName(b), frames) if frames else None


def changed_parts(before: Version | None, after: Version) -> set[str]:
    """Partitions that ``after`` has and ``before`` had not, or had with other rows."""
    known = before.body["parts"] if before else {}
    return {p for p, held in after.body["parts"].items() if known.get(p, {}).get("folder") != held["folder"]}


def refresh(spark: SparkSession, source: str, path: str, partition_cols: tuple[str, ...],
            make: Callable[[DataFrame], DataFrame]) -> Version:
    """Bring the aggregate at ``path`` up to date with the newest version of the table at
    ``source``.  ``make`` aggregates rows of some partitions to rows of the same
    partitions; it is given those alone whose folder has changed since the last refresh,
    and the others are neither read nor written."""
    of, mine = versions.latest(spark, source), versions.latest(spark, path)
    known = mine.body["parts"] if mine else {}
    todo = [p for p, held in of.body["parts"].items() if known.get(p, {}).get("source") != held["folder"]]
    gone = known.keys() - of.body["parts"].keys()
    if mine and not todo and not gone:
        return mine
    rows = read_parts(spark, of, todo) if todo else None
    attempt = files.write_attempt(make(rows), path, partition_cols) if rows is not None else None
    parts = {p: held for p, held in known.items() if p not in gone}
    parts |= {p: {"folder": f"{attempt}/{p}", "source": of.body["parts"][p]["folder"]} for p in todo}
    return versions.commit(spark, path, sorted(p["folder"] for p in parts.values()), parts=parts, source_version=of.number)
