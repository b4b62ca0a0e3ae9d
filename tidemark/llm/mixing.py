"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow of shuffled documents, played up to ``epochs`` times.  A
document's virtual finish time is its source's cumulative words, itself
included, divided by the source's weight (its target).  All flows are merged in
the order of virtual finish and cut where the total budget is reached, so each
source has then spent about its target.

Cumulative sums run in two levels: a source is dealt into ranges of its
shuffle key, whose totals are added up first, and a window then sums inside a
range.  No task sees a whole source, however large.  The cut is found the same
way over ranges of virtual time.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, scalar, stage, text_or_empty

PIECE_DIGITS = 3  # leading hexadecimal digits of the shuffle key: 4096 ranges
TIME_BINS = 4096  # per unit of virtual time


def word_count(col: Column | str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def shuffle_key(seed: int) -> Column:
    """Hexadecimal; equal only for rows of equal doc_id and text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), own, F.md5(text_or_empty().cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
            epochs: int = 2) -> DataFrame:
    """Per source (columns source, source_size): index, weight and target.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` times all sizes in proportion, but none above ``epochs`` times its
    own size; what is left over is shared again.  That ends at one water level: a
    source is full when the level reaches its limit divided by its weight, so
    sources in the order of that ratio fill one after the other.
    """
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("index", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cyc, F.col("index") % len(weights) + 1))
    limit = F.col("source_size") * float(epochs)
    ranked = ranked.withColumn("limit", limit).withColumn("ratio", limit / F.col("weight"))
    every = Window.partitionBy()
    earlier = Window.orderBy("ratio", "index").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "budget": F.sum("source_size").over(every) * float(share),
        "all_weight": F.sum("weight").over(every),
        "limit_before": F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
    })
    full = F.col("ratio") * (F.col("all_weight") - F.col("weight_before")) <= F.col("budget") - F.col("limit_before")
    ranked = ranked.withColumn("full", full)
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return ranked.select("source", "source_size", "index", "weight",
                         F.when(F.col("full"), F.col("limit"))
                         .otherwise(F.col("weight") * left / open_weight).alias("target"))


def _timed(rows: DataFrame, plan: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows with their source's plan and ``finish``, the virtual finish time in
    the first epoch, and ``turn``, what one more epoch adds."""
    inside = (Window.partitionBy("mix_index", "mix_piece").orderBy("mix_key", "doc_id", "mix_size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keyed = rows.join(plan, F.col("mix_source").eqNullSafe(rows["source"])).drop("mix_source")
    keyed = keyed.join(starts, ["mix_index", "mix_piece"])
    spent = F.col("mix_start") + F.sum("mix_size").over(inside)
    return keyed.withColumns({"finish": F.when(F.col("target") > 0, spent / F.col("target")).otherwise(0.0),
                              "turn": F.when(F.col("target") > 0, F.col("source_size") / F.col("target"))
                              .otherwise(0.0)}).drop("mix_start")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    key = shuffle_key(seed)
    return docs.withColumns({"mix_size": word_count(), "mix_key": key,
                             "mix_piece": F.substring(key, 1, PIECE_DIGITS)})


def _schedule(thin: DataFrame, weights, share, epochs) -> tuple[DataFrame, DataFrame, float]:
    """Plan per source, word offsets per piece, and the virtual time of the cut."""
    sizes = thin.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    plan = stage(targets(sizes, weights, share, epochs).select(
        F.col("source").alias("mix_source"), "source_size", F.col("index").alias("mix_index"), "target"), "mix_plan")
    earlier = (Window.partitionBy("mix_index").orderBy("mix_piece")
               .rowsBetween(Window.unboundedPreceding, -1))  # at most 4096 rows a source
    pieces = thin.groupBy("source", "mix_piece").agg(F.sum("mix_size").alias("words"))
    starts = stage(pieces.join(plan, F.col("mix_source").eqNullSafe(pieces["source"]))
                   .select("mix_index", "mix_piece", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("mix_start")),
                   "mix_starts")
    timed = _timed(thin, plan, starts).select("mix_size", F.explode(F.array(
        *[F.col("finish") + float(e) * F.col("turn") for e in range(epochs)])).alias("finish"))
    timed = stage(timed.withColumn("bin", F.least(F.floor(F.col("finish") * TIME_BINS), F.lit(2 * TIME_BINS)).cast("int")),
                  "mix_times")
    budget = float(share) * scalar(plan.agg(F.sum("source_size")), 0)
    bins = timed.groupBy("bin").agg(F.sum("mix_size").alias("words"))
    upto = bins.withColumn("upto", F.sum("words").over(Window.orderBy("bin")))  # at most 2 * TIME_BINS + 1 rows
    over = upto.filter(F.col("upto") > budget).orderBy("bin").select("bin", F.col("upto") - F.col("words")).first()
    if over is None:
        return plan, starts, float("inf")
    tail = timed.filter(F.col("bin") == over[0])
    tail = tail.groupBy("finish").agg(F.sum("mix_size").alias("words"))
    tail = tail.withColumn("upto", F.lit(over[1]) + F.sum("words").over(Window.orderBy("finish")))
    cut = scalar(tail.filter(F.col("upto") <= budget).agg(F.max("finish")))
    if cut is None:
        cut = scalar(timed.filter(F.col("bin") < over[0]).agg(F.max("finish")), -1.0)
    return plan, starts, float(cut)


def _taken(timed: DataFrame, cut: float, epochs: int) -> DataFrame:
    copies = sum((F.when(F.col("finish") + float(e) * F.col("turn") <= cut, 1).otherwise(0) for e in range(epochs)),
                 F.lit(0))
    return timed.withColumn("copies", copies)


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2,
               seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    finish (virtual time), copies (0 to ``epochs``) and taken words.

    A null text has no words; a null source is a source of its own, last in
    order.  Documents are taken whole.  Repeated rows are separate documents.
    Equal finish times are all in or all out.  Reruns give the same rows.
    """
    thin = stage(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix_rows")
    plan, starts, cut = _schedule(thin, weights, share, epochs)
    return _taken(_timed(thin, plan, starts), cut, epochs).select(
        "doc_id", "source", F.col("mix_size").alias("size"), "source_size", "target", "finish", "copies",
        (F.col("mix_size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2,
        seed: int = 11) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of
    ``docs``, range-sorted by virtual finish time.  A document of no words is
    passed on once, as it takes nothing from the budget."""
    thin = stage(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix_rows")
    plan, starts, cut = _schedule(thin, weights, share, epochs)
    clear = {"mix_size", "mix_key", "mix_piece", "mix_index", "mix_source", "mix_start", "source_size", "target",
             "finish", "turn", "copies", "copy"}
    kept = {c: f"own_{i}" if c in clear else c for i, c in enumerate(docs.columns)}
    timed = _timed(_keyed(docs.withColumnsRenamed(kept), seed), plan, starts)
    taken = _taken(timed, cut, epochs)
    times = F.when(F.col("mix_size") == 0, F.array(F.lit(0))).otherwise(
        F.expr("transform(sequence(1, greatest(copies, 1)), i -> i - 1)"))
    out = taken.filter((F.col("copies") > 0) | (F.col("mix_size") == 0)).withColumn("copy", F.explode(times))
    out = out.orderBy(F.col("finish") + F.col("copy") * F.col("turn"), "mix_key")
    return out.select(*[F.col(k).alias(c) for c, k in kept.items()])
