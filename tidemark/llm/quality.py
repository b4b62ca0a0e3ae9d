"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few shape features (shares of character classes, word and
repetition statistics), each cut into bins.  Training cycles over the features
and fits one shallow tree at a time to the residuals; the trees of a feature add
up to one lookup table over its bins.  The strongest feature pairs then get small
two-way tables in the same way.  A score is a sum of table entries, so scoring is
a few vectorised additions, and the model is a few kilobytes.

The model is fitted on the driver to a sample of at most ``sample_rows`` labelled
rows (the rows whose id hashes lowest, the same on every run); features are
computed by Spark for those rows and for all rows to be scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import byte_blocks, text_bytes, word_hashes, word_spans

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BLOCK = 1 << 18  # text bytes handled at once

# character classes of bytes; everything from 0x80 on counts as a letter of another script
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _BANG, _MARK, _OTHER = range(9)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _UPPER, _LOWER, _DIGIT, _OTHER
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _CLASS[0x0A] = _SPACE, _LINE
_CLASS[[ord(c) for c in ".,;:?'\"-()"]], _CLASS[ord("!")] = _STOP, _BANG

FEATURES = ("log_bytes", "log_words", "upper", "digit", "line", "stop", "bang", "mark", "other", "word_length",
            "word_spread", "distinct_words", "top_word", "repeated_word", "repeated_pair", "shouted_words",
            "marked_words", "short_words", "words_per_line", "distinct_lines")


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per text and the count of the most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    counts = np.diff(np.r_[first, len(h)])
    top = np.zeros(n)
    np.maximum.at(top, o[first], counts)
    return np.bincount(o[first], minlength=n).astype(float), top


def features(texts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _CLASS[data]
    counts = np.bincount(owner * 9 + kinds, minlength=9 * n).reshape(n, 9).astype(float)
    starts, ends, bounds = word_spans(data, offsets)
    hashes, lens = word_hashes(data, starts, ends), (ends - starts).astype(float)
    words = np.diff(bounds).astype(float)
    own = np.repeat(np.arange(n), np.diff(bounds))
    some, any_bytes = np.maximum(words, 1), np.maximum(size, 1)
    mean = _per_text(lens, bounds) / some
    distinct, top = _repeats(hashes, own, n)
    same = np.zeros(len(hashes))
    pair = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    pair[2:] = (hashes[2:] == hashes[:-2]) & (own[2:] == own[:-2])
    upper = np.concatenate([[0], np.cumsum(kinds == _UPPER)])
    lower = np.concatenate([[0], np.cumsum((kinds == _LOWER) | (kinds == _OTHER))])
    shouted = (upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts])
    last = kinds[ends - 1] if len(ends) else kinds[:0]
    line_starts, line_ends, line_bounds = word_spans(data, offsets, _CLASS_IS_LINE)
    lines = np.diff(line_bounds).astype(float)
    line_own = np.repeat(np.arange(n), np.diff(line_bounds))
    distinct_lines, _ = _repeats(word_hashes(data, line_starts, line_ends), line_own, n)
    share = counts / any_bytes[:, None]
    return np.column_stack([
        np.log1p(size), np.log1p(words), share[:, _UPPER], share[:, _DIGIT], share[:, _LINE], share[:, _STOP],
        share[:, _BANG], share[:, _MARK], share[:, _OTHER], mean,
        np.sqrt(np.maximum(_per_text(lens * lens, bounds) / some - mean * mean, 0)), distinct / some, top / some,
        _per_text(same, bounds) / some, _per_text(pair, bounds) / some, _per_text(shouted, bounds) / some,
        _per_text((last == _MARK) | (last == _BANG), bounds) / some, _per_text(lens <= 2, bounds) / some,
        words / np.maximum(lines, 1), distinct_lines / np.maximum(lines, 1)])


_CLASS_IS_LINE = np.zeros(256, bool)
_CLASS_IS_LINE[0x0A] = True


@dataclass(frozen=True)
class AdditiveModel:
    """Bin edges and tables per feature, two-way tables per feature pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]  # over bins merged by COARSE

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for i, j, table in self.pairs:
            z += table[b[:, i] // COARSE, b[:, j] // COARSE]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


BINS = 32
COARSE = 4  # bins merged into one for pairs


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A shallow tree over ordered bins (at most three leaves) as a table."""
    def split(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
        gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    n = len(g)
    gain, at = split(0, n)
    if gain <= 0:
        return np.zeros(n)
    (g1, a1), (g2, a2) = split(0, at), split(at, n)
    cuts = sorted({0, at, n} | ({a1} if g1 >= g2 and g1 > 0 else {a2} if g2 > 0 else set()))
    out = np.zeros(n)
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four-leaf cut of a two-way table (one cut a side) and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ng, nh = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quarters = ((a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b),
                (ng - cg[:-1, -1:] - cg[-1:, :-1] + a, nh - ch[:-1, -1:] - ch[-1:, :-1] + b))
    gain = sum(x * x / (y + 1) for x, y in quarters)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for rows, cols in ((slice(0, r + 1), slice(0, c + 1)), (slice(0, r + 1), slice(c + 1, None)),
                       (slice(r + 1, None), slice(0, c + 1)), (slice(r + 1, None), slice(c + 1, None))):
        out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain[r, c]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6,
        rate: float = 0.15) -> AdditiveModel:
    """Cyclic boosting of one tree a feature and round, then of the best pairs.
    Without rows of both classes the model is a constant (one half without rows)."""
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0)
             for j in range(len(FEATURES))]
    model = AdditiveModel(0.0, edges, [np.zeros(len(e) + 1) for e in edges], [])
    if not len(y):
        return model
    prior = float(np.clip(y.mean(), 0.001, 0.999))
    model = AdditiveModel(float(np.log(prior / (1 - prior))), edges, model.tables, [])
    if y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slope()
            add = rate * _step(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
            table += add
            z += add[b[:, j]]
    c = b // COARSE
    width = BINS // COARSE + 1

    def two_way(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slope()
        cell = c[:, i] * width + c[:, j]
        return tuple(np.bincount(cell, v, width * width).reshape(width, width) for v in (g, h))

    m = len(edges)
    ranked = sorted(((_pair_step(*two_way(i, j))[0], i, j) for i in range(m) for j in range(i + 1, m)), reverse=True)
    chosen = [(i, j, np.zeros((width, width))) for _, i, j in ranked[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            add = rate * _pair_step(*two_way(i, j))[1]
            table += add
            z += add[c[:, i], c[:, j]]
    return AdditiveModel(model.intercept, edges, model.tables, chosen)


def held_out() -> Column:
    """Rows that no model learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit to labelled, not held out rows; null labels and null ids are left out.  At most
    ``sample_rows`` rows are used, those of the lowest id and text hashes, however many
    rows share an id."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = (known.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("double").alias("label"))
              .orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", BLOCK):
            x = features(block.column("text"))
            yield pa.RecordBatch.from_arrays(
                [block.column("place").combine_chunks(), block.column("doc_id").combine_chunks().cast(pa.string()),
                 block.column("label").combine_chunks(), pa.array(list(x), pa.list_(pa.float64()))], ["place", "id", "y", "x"])

    place = F.struct(F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"), F.col("label").alias("c"))
    seen = rows.select(place.alias("place"), "doc_id", "label", "text").mapInArrow(
        run, "place struct<a:long,b:long,c:double>, id string, y double, x array<double>")
    got = seen.orderBy("place").limit(sample_rows).drop("place").toPandas()
    got = got.sort_values(["id", "y"]).reset_index(drop=True)  # the same fit whatever order the rows come in
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy())


def with_scores(docs: DataFrame, model: AdditiveModel, column: str = "score") -> DataFrame:
    """``docs`` with ``column`` added last: the probability of label 1.

    Null and empty texts get the score of a text without bytes.  Repeated rows
    stay; an empty table gives an empty result.  ``column`` must be a new name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", BLOCK):
            scores = pa.array(shared.value.scores(features(block.column("text"))))
            for batch in block.append_column(column, scores).combine_chunks().to_batches():
                yield batch

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = train(docs, labels, sample_rows)
    return with_scores(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
