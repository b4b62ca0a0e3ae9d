"""Connected components of a graph given as an edge table.

Every task runs union-find over the links it holds and passes on a spanning forest
of them, at most one link a vertex.  A forest of up to ``ONE_TASK`` links is
finished by union-find in one task; a larger one by rounds that hook vertices to
smaller ones across tasks.  Both ways end at the same roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

ONE_TASK = 300_000  # links, some hundred bytes each


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex of the links with the smallest vertex that they connect it to."""
    parent: dict[bytes, bytes] = {}

    def top(v: bytes) -> bytes:
        root = v
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[v] != root:
            parent[v], v = root, parent[v]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    links = [(v, top(v)) for v in parent]
    for at in range(0, len(links), 10_000):
        part = [x for x in links[at:at + 10_000] if x[0] != x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.binary()) for i in (0, 1)], ["a", "b"])


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def _hook(edges: DataFrame) -> DataFrame:
    """One round: both ends of a link are linked to the smallest vertex at or next
    to the other end, and every vertex to its own smallest neighbour.  The smallest
    neighbours are partial aggregates, staged so that the join back to a hub's many
    links can be split."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), "least_neighbours")
    far = both.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("root").alias("b"))
    return _oriented(far.union(least.select("a", F.col("root").alias("b"))))


def _hooked(links: DataFrame) -> DataFrame:
    """Rounds, each written to the shared folder, until one changes nothing; then every
    vertex is linked to its root alone.  Their number grows with the logarithm of the
    longest path."""
    now, state = stage(_oriented(links), "links"), None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new[0] == 0 or new == state:
            return now
        now, state = stage(_hook(now), "links"), new


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Vertices of ``edges`` (binary columns a, b; a row is a link) with ``root``, the
    smallest vertex of their component.  Only vertices that have a link to another
    one are returned."""
    forest = stage(edges.select("a", "b").mapInArrow(_forest, "a binary, b binary"), "forest")
    if forest.count() <= one_task:
        rooted = stage(forest.coalesce(1).mapInArrow(_forest, "a binary, b binary"), "links")
    else:
        rooted = _hooked(forest)
    vertices = rooted.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return vertices.union(rooted.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
