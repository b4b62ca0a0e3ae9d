"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in shards of a few megabytes of text: for every term that
the benchmark uses, the sorted positions at which it stands in the shard.  A
window of the benchmark is looked up by intersecting its terms' lists, each moved
back by the term's offset, from the term that is rarest in the shard to the most
frequent; most windows end at the first or second list.  Proximity matches allow
each term to stand a few words off its place.

Shards are made and searched where the documents are, so postings are not
shuffled.  The benchmark goes to every task in blocks of bounded size, one block at a
time; a block's postings are deleted once its hits are staged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import byte_blocks, free_names, stage, text_bytes, unstage, word_hashes, word_spans

WINDOW = 13
GAP = 64                      # free positions between documents, more than a window and its slop
SHARD = 3 << 20               # text bytes indexed together
BENCHMARK_BLOCK = 8 << 20     # benchmark text bytes sent to the tasks at once (some 13 times that in memory)
SLOP = 2                      # words that a term may stand off its place in a proximity match

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, bool)  # bytes that are in no word, once A-Z are lower-cased
_BREAK[0x00:0x30] = _BREAK[0x3A:0x61] = _BREAK[0x7B:0x80] = True


def term_hashes(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words come before each text."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, _BREAK)
    return word_hashes(data, starts, ends), bounds


@dataclass(frozen=True)
class Windows:
    """Distinct windows of a benchmark: term numbers (-1 beyond a short item's
    end), lengths, and the items in which each occurs."""

    vocabulary: np.ndarray  # sorted term hashes
    terms: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @staticmethod
    def of(items: list[tuple[str, str]], width: int = WINDOW) -> Windows:
        hashes, bounds = term_hashes(pa.array([t for _, t in items], pa.string()))
        vocabulary = np.unique(hashes)
        terms = np.searchsorted(vocabulary, hashes)
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for (item, _), lo, hi in zip(items, bounds, bounds[1:]):
            words = terms[lo:hi].tolist()
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found[tuple(words[i:i + width])].add(item)
        keys = sorted(found)
        table = np.full((len(keys), width), -1, np.int64)
        for row, key in zip(table, keys):
            row[:len(key)] = key
        return Windows(vocabulary, table, np.array([len(k) for k in keys], np.int64), [sorted(found[k]) for k in keys])


@dataclass(frozen=True)
class Shard:
    """Postings of one shard: ``positions[first[t]:first[t + 1]]`` are those of term t."""

    bounds: np.ndarray  # words before each document
    first: np.ndarray
    positions: np.ndarray

    @staticmethod
    def of(texts: pa.ChunkedArray | pa.Array, vocabulary: np.ndarray) -> Shard:
        hashes, bounds = term_hashes(texts)
        n = len(vocabulary)
        if n == 0 or len(hashes) == 0:
            return Shard(bounds, np.zeros(n + 1, np.int64), np.zeros(0, np.int64))
        term = np.minimum(np.searchsorted(vocabulary, hashes), n - 1)
        known = np.flatnonzero(vocabulary[term] == hashes)
        place = known + GAP * (np.searchsorted(bounds, known, side="right") - 1)
        term = term[known]
        order = np.argsort(term, kind="stable")
        return Shard(bounds, np.searchsorted(term[order], np.arange(n + 1)), place[order])

    def search(self, windows: Windows, slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(window number, sorted start positions) of the windows that occur.  With
        ``slop`` every term may stand that many words before or after its place; this
        holds of a start whichever term is looked up first."""
        counts = np.diff(self.first)
        used = windows.terms >= 0
        own = np.where(used, counts[windows.terms] if len(counts) else 0, np.iinfo(np.int64).max)
        for w in np.flatnonzero((own.min(axis=1, initial=np.iinfo(np.int64).max) > 0) & (windows.lengths > 0)):
            terms = windows.terms[w]
            by_rarity = np.argsort(own[w], kind="stable")[:windows.lengths[w]]
            at = None
            for offset in by_rarity:
                term = terms[offset]
                listed = self.positions[self.first[term]:self.first[term + 1]] - offset
                if at is None:
                    at = listed if not slop else np.unique(listed[:, None] + np.arange(-slop, slop + 1))
                    continue
                i = np.searchsorted(listed, at - slop)
                ok = i < len(listed)
                ok[ok] = listed[i[ok]] <= at[ok] + slop
                at = at[ok]
                if not len(at):
                    break
            if len(at):
                yield int(w), at


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    """Runs covered by the given intervals."""
    out: list[dict[str, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1]["s"] + out[-1]["n"]:
            out[-1]["n"] = max(out[-1]["n"], e - out[-1]["s"])
        else:
            out.append({"s": s, "n": e - s})
    return out


_RUN = pa.struct([("s", pa.int64()), ("n", pa.int64())])


def hits(shard: Shard, windows: Windows, slop: int = 0) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Per document of the shard: covered runs of words (start and length), items
    with an occurring window, and items with a proximity match."""
    docs = len(shard.bounds) - 1
    doc_start = shard.bounds[:-1] + GAP * np.arange(docs)
    runs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    near: dict[int, set[str]] = defaultdict(set)
    for w, at in shard.search(windows):
        doc = np.searchsorted(doc_start, at, side="right") - 1
        for d in np.unique(doc).tolist():
            own = at[doc == d] - doc_start[d]
            runs[d].append((own, own + windows.lengths[w]))
            items[d].update(windows.items[w])
    if slop:
        for w, at in shard.search(windows, slop):
            for d in np.unique(np.searchsorted(doc_start, at + GAP // 4, side="right") - 1).tolist():
                near[d].update(windows.items[w])
    merged = [_merged(*(np.concatenate(x) for x in zip(*runs[d]))) if d in runs else [] for d in range(docs)]
    return (pa.array(merged, pa.list_(_RUN)), pa.array([sorted(items.get(d, ())) for d in range(docs)], pa.list_(pa.string())),
            pa.array([sorted(near.get(d, ())) for d in range(docs)], pa.list_(pa.string())))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter(
        F.col("text").isNotNull())


def block_total(benchmark: DataFrame, limit: int = BENCHMARK_BLOCK) -> int:
    """How many blocks of about ``limit`` bytes of text the benchmark makes."""
    size = _items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-size // limit) or 1


def benchmark_block(benchmark: DataFrame, block: int, blocks: int) -> Windows:
    """The windows of one block.  Items without words have no window; a null id shows
    as ``""``.  At most a block's text reaches the driver."""
    rows = _items(benchmark).filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
    return Windows.of(sorted((r.item, r.text) for r in rows))


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id and text of all documents, staged: every later pass over them sees the
    same row numbers."""
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered_docs")


def build_index(rows: DataFrame, windows: Windows) -> DataFrame:
    """Stored postings of ``rows`` (row, doc_id, text) for the terms of ``windows``: a row
    per shard.  ``row`` is whatever tells rows apart."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(windows.vocabulary)
    row_type, id_type = (rows.schema[c].dataType.simpleString() for c in ("row", "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", SHARD):
            shard = Shard.of(block.column("text"), vocabulary.value)
            of = [block.column(c).combine_chunks() for c in ("row", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [*[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in of],
                 *[pa.array([x], pa.list_(pa.int64())) for x in (shard.bounds, shard.first, shard.positions)]],
                ["rows", "doc_ids", "bounds", "first", "positions"])

    made = rows.select("row", "doc_id", "text").mapInArrow(
        run, f"rows array<{row_type}>, doc_ids array<{id_type}>, bounds array<long>, first array<long>, positions array<long>")
    return stage(made, "postings")


def search_index(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """row, doc_id, n_words, runs, items and near per indexed document."""
    shared = index.sparkSession.sparkContext.broadcast(windows)
    row_type, id_type = (index.schema[c].dataType.elementType.simpleString() for c in ("rows", "doc_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, ids = (batch.column(c)[i].values for c in ("rows", "doc_ids"))
                bounds, first, positions = (batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                                            for c in ("bounds", "first", "positions"))
                found = hits(Shard(bounds, first, positions), shared.value, slop)
                yield pa.RecordBatch.from_arrays([rows, ids, pa.array(np.diff(bounds)), *found],
                                                 ["row", "doc_id", "n_words", "runs", "items", "near"])

    return index.mapInArrow(run, f"row {row_type}, doc_id {id_type}, n_words long, "
                                 "runs array<struct<s:long,n:long>>, items array<string>, near array<string>")


def _found(rows: DataFrame, benchmark: DataFrame, slop: int, block_bytes: int) -> DataFrame:
    """``search_index`` over all blocks of the benchmark, merged by ``row`` where there are
    several."""
    found, blocks = None, block_total(benchmark, block_bytes)
    for b in range(blocks):
        windows = benchmark_block(benchmark, b, blocks)
        index = build_index(rows, windows)
        hit = stage(search_index(index, windows, slop), "benchmark_hits")
        unstage(index)
        found = hit if found is None else found.unionByName(hit)
    if blocks == 1:
        return found
    return found.groupBy("row", "doc_id", "n_words").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "items", "near")])  # rows of one text, one per block


def hit_words(runs: Column) -> Column:
    """Words covered by runs that may overlap."""
    return F.aggregate(
        F.array_sort(runs), F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto")),
        lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(x["s"], a["upto"]))).alias("hit"),
                              F.greatest(a["upto"], x["s"] + x["n"]).alias("upto")), lambda a: a["hit"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: a twentieth of the words or more is covered."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def find(docs: DataFrame, benchmark: DataFrame, slop: int = 0, block_bytes: int = BENCHMARK_BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (covered words), n_hit,
    items, near_items (with a ``slop``: items with a window whose words all stand
    within ``slop`` words of their places) and contaminated.

    Null and empty texts have no words and are clean.  A benchmark item of fewer
    words than a window is one window; without words it has none.  Repeated rows
    stay; an empty table gives an empty result; other columns are ignored.
    """
    if block_total(benchmark, block_bytes) > 1:
        rows = numbered(docs)
    else:  # one pass: a row is told by its number in that pass
        rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    n_hit = hit_words(F.col("runs"))
    return _found(rows, benchmark, slop, block_bytes).select(
        "doc_id", "n_words", "runs", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"),
        F.array_sort(F.array_distinct("near")).alias("near_items"), contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BENCHMARK_BLOCK) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns whatever these
    are called: null and empty texts have no words and stay, texts of any length are
    read whole, repeated rows share their fate, an empty table gives an empty result.

    Whether a text is contaminated depends on the text alone, so rows are told by its
    digest, whatever plan they come from.  A Bloom filter over the contaminated texts
    lets all other rows pass straight through; only rows that may be contaminated are
    joined with the digests of those that are, so few texts move.
    """
    (bad,) = free_names(docs, "contaminated_text")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    n_hit = hit_words(F.col("runs"))
    found = _found(docs.select(digest.alias("row"), F.lit(0).alias("doc_id"), "text"), benchmark, 0, block_bytes)
    dirty = stage(found.filter(contaminated(n_hit, F.col("n_words"))).select(F.col("row").alias(bad)).distinct(), "contaminated_texts")
    hashes = dirty.select(F.xxhash64(bad).alias("h"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bloom.build(hashes, dirty.count()))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        slots = bloom.hash_slots(h.to_numpy(np.int64).view(np.uint64), len(bitmap.value) * 8)
        return pd.Series(bloom.has(bitmap.value, slots).all(axis=1))

    suspect = maybe(F.xxhash64(digest))
    return docs.filter(~suspect).unionByName(docs.filter(suspect).join(dirty, digest == F.col(bad), "left_anti"))
