"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

A text's set holds its distinct shingles of five words.  In a SuperMinHash
signature every shingle draws one random permutation of the components and gives
the component in place j of it a value between j and j + 1; a component keeps its
smallest value.  The values of one shingle are thus correlated (all different
ranks), which lowers the variance against plain MinHash, and once every component
holds a value below j no later place can change the signature, so long texts stop
after a few places.

Equal sets are one class from the start.  Classes that agree in a whole band of
their signatures meet in a bucket.  Buckets are not expanded into pairs: links are
proposed from a bucket's pivot to its members and confirmed on the full sets, round
by round with new pivots, until a round confirms hardly any.  By then what belongs
together is connected.  Members of a bucket that are still in different components
are compared by their signatures inside the tasks, and only pairs whose estimate
comes near the threshold go on to be confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import byte_blocks, free_names, mix64, stage, text_bytes, word_hashes, word_spans
from tidemark.llm.components import components

WORDS = 5
SIMILAR = 75          # per cent of the union that two sets share at least
PLACES = 256          # components of a signature
BANDED = 128          # components that make bands; all of them make estimates
ROWS = 4              # components of a band: a pair at 75 % misses all 32 bands once in 190,000
BLOCK = 1 << 18       # text bytes handled at once
VERIFY_BLOCK = 1 << 18
STAR_ROUNDS = 4       # rounds of pivots at most before signatures are compared
HARDLY_ANY = 0.01     # links confirmed per member in the last round of pivots
GROUP = 2048          # members of a bucket compared in one task; larger ones are dealt into blocks
NEAR = 157 / PLACES   # estimate from which a pair is confirmed: one at 75 % is under it once in 2,000,000
COMPARE = 256         # members compared with one another at a time
DENSE = 1             # pairs of a tile per member from which they are settled together
COLUMNS = 4096        # shingles counted at a time
TILE = 1 << 19        # shingles of the members compared at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_A = np.uint64(0x9FB21C651E98DF25)
_STEPS = np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    runs = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        runs = words[:len(words) - WORDS + 1].copy()
        for i in range(1, WORDS):
            runs = mix64(runs * _A + words[i:len(words) - WORDS + 1 + i])
    out = []
    for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
        if hi - lo >= WORDS:
            out.append(np.unique(runs[lo:hi - WORDS + 1]))
        elif hi > lo:  # the whole sequence is one shingle
            one = words[lo:lo + 1] + np.uint64(hi - lo)
            for i in range(lo + 1, hi):
                one = mix64(one * _A + words[i:i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures of shape (sets, places); rows of empty sets are all ones.

    A value is the place in the shingle's permutation (high 16 bits) and 48 random
    bits.  All shingles of all sets advance place by place; a set leaves when each
    of its components holds an earlier place than the next one.
    """
    n = len(sets)
    out = np.full((n, places), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(items), 1))
    for place in range(places):
        if not len(items):
            break
        drawn = mix64(items + _STEPS[place])
        swap = place + (drawn >> np.uint64(48)).astype(np.int64) % (places - place)
        rows = np.arange(len(items))
        to = order[rows, swap]
        order[rows, swap] = order[:, place]
        value = (np.uint64(place) << np.uint64(48)) | (drawn & np.uint64((1 << 48) - 1))
        np.minimum.at(flat, owner * places + to, value)
        alive = np.unique(owner)
        open_ = np.zeros(n, bool)
        open_[alive] = out[alive].max(axis=1) >= np.uint64(place + 1) << np.uint64(48)
        keep = open_[owner]
        if not keep.all():
            items, owner, order = items[keep], owner[keep], order[keep]
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of each signature; a key holds its band's number."""
    n, places = signatures.shape
    bands = signatures.reshape(n, places // rows, rows)
    key = np.tile(np.arange(1, places // rows + 1, dtype=np.uint64), (n, 1))
    for i in range(rows):
        key = mix64(key * _A + bands[:, :, i])
    return key


def set_ids(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that depend on the set alone; None for the empty set."""
    out: list[bytes | None] = []
    for s in sets:
        sums = [int(mix64(s ^ np.uint64(c)).sum(dtype=np.uint64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        out.append((sums[0].to_bytes(8, "big") + (sums[1] ^ len(s)).to_bytes(8, "big")) if len(s) else None)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id, band keys and a byte per component of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", BLOCK):
            sets = shingle_sets(block.column("text"))
            signatures = superminhash(sets)
            keys = band_keys(signatures[:, :BANDED]).view(np.int64)
            print_ = signatures.astype(np.uint8)  # the lowest byte of each component
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * keys.shape[1], pa.int32()),
                                             pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").combine_chunks(), block.column("text_hash").combine_chunks(),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(set_ids(sets), pa.binary()), bands,
                 pa.array([x.tobytes() for x in print_], pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_id", "bands", "print"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return stage(docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(
        run, f"doc_id {id_type}, text_hash long, n_shingles long, set_id binary, bands array<long>, print binary"), "signatures")


def text_hash() -> Column:
    """Tells rows of one doc_id apart that hold different texts."""
    return F.xxhash64("text")


def _id_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and text of the classes in ``wanted`` (set_id, doc_id): one text each.

    A Bloom filter on the ids of the classes' first documents keeps other texts out
    of the shuffle; set ids computed anew from the texts decide.
    """
    ids = stage(wanted.select(_id_hash().alias("h")).distinct(), "wanted_ids")
    bitmap = docs.sparkSession.sparkContext.broadcast(bloom.build(ids, ids.count()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
                    ok = bloom.has(bitmap.value, bloom.hash_slots(h, len(bitmap.value) * 8)).all(axis=1)
                    yield batch.filter(pa.array(ok))
        for block in byte_blocks(passed(), "text", BLOCK):
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_ids(shingle_sets(block.column("text"))), pa.binary()),
                 block.column("text").combine_chunks().cast(pa.string())], ["set_id", "text"])

    found = docs.select("text", _id_hash().alias("h")).mapInArrow(pick, "set_id binary, text string")
    found = found.join(wanted.select("set_id"), "set_id", "left_semi")
    return stage(found.groupBy("set_id").agg(F.first("text").alias("text")), "class_texts")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (columns a, b) whose full sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text_a", VERIFY_BLOCK):
            keep = []
            for one, two in zip(shingle_sets(block.column("text_a")), shingle_sets(block.column("text_b"))):
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= SIMILAR * (len(one) + len(two) - both))
            for batch in block.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches():
                yield batch

    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a binary, b binary")


def _star_pairs(buckets: DataFrame, seed: int) -> DataFrame:
    """From each bucket's pivot to its members of other components."""
    rank = F.xxhash64(F.lit(seed), "v")
    pivots = stage(buckets.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "v", "root")).alias("p"))
                   .select("key", F.col("p.v").alias("pivot"), F.col("p.root").alias("pivot_root")), "pivots")
    met = buckets.join(pivots, "key").filter(F.col("root") != F.col("pivot_root"))
    return met.select(F.greatest("v", "pivot").alias("a"), F.least("v", "pivot").alias("b")).distinct()


def _open_buckets(placed: DataFrame) -> DataFrame:
    """Buckets that still hold several components, with their number of members."""
    roots = placed.groupBy("key", "root").count().groupBy("key").agg(F.count("*").alias("roots"), F.sum("count").alias("n"))
    return stage(roots.filter("roots > 1").select("key", "n"), "open_buckets")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``, by which rows come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if held and held[-1].column(key)[0] != batch.column(key)[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _tiles(members: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Runs of up to COMPARE members that hold up to TILE shingles, one member at least."""
    out, lo, held = [], 0, 0
    for i, n in enumerate(sizes[members].tolist()):
        if i > lo and (i - lo == COMPARE or held + n > TILE):
            out.append(members[lo:i])
            lo, held = i, 0
        held += n
    return [*out, members[lo:]] if len(members) else out


def _agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many places each row of ``one`` equals each row of ``two``."""
    if len(one) * len(two) <= 1024:
        return (one[:, None, :] == two[None, :, :]).sum(axis=2)
    same = np.zeros((len(one), len(two)), np.uint16)
    for x, y in zip(np.ascontiguousarray(one.T), np.ascontiguousarray(two.T)):
        same += x[:, None] == y[None, :]
    return same


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each group (equal meet, rows come sorted by
    it) that are near by their signatures, tile by tile: rows of side 0 against rows
    of side 1, rows of side 2 against one another.  A pair meets in the buckets of
    several bands and is given by the first band it shares.

    Few pairs of a tile are given as such (a, b).  Many are given as the tile's members
    (tile, place, a), a left one with a bit per right one it pairs with (b).
    """
    for group in _runs(batches, "meet"):
        group = group.combine_chunks()
        side, sizes = group.column("side").to_numpy(), group.column("n_shingles").to_numpy()
        if group.num_rows < 2:
            continue
        v, root = group.column("v").to_pylist(), group.column("root").to_pylist()
        code = {r: i for i, r in enumerate(dict.fromkeys(root))}
        own = np.array([code[r] for r in root])
        prints = np.frombuffer(b"".join(group.column("print").to_pylist()), np.uint8).reshape(len(v), -1)
        keys = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint32).reshape(len(v), -1)
        band, meet = group.column("band")[0].as_py(), group.column("meet").to_numpy()[:1].view(np.uint64)
        order = np.argsort(own, kind="stable")  # tiles of one component are passed over
        left, right = (_tiles(order[side[order] != gone], sizes) for gone in (1, 0))
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                if side[p[0]] == 2 and j < i or (own[p] == own[p[0]]).all() and (own[q] == own[p[0]]).all():
                    continue
                fit = own[p][:, None] != own[q][None, :]
                if side[p[0]] == 2 and i == j:
                    fit = np.triu(fit, 1)
                small, large = (f(sizes[p][:, None], sizes[q][None, :]) for f in (np.minimum, np.maximum))
                fit &= 100 * small >= SIMILAR * large
                if not fit.any():
                    continue
                x, y = np.nonzero(fit & (_agreeing(prints[p], prints[q]) >= NEAR * PLACES))
                shared = keys[p[x]] == keys[q[y]]
                given = shared.any(axis=1) & (np.argmax(shared, axis=1) == band)
                x, y = x[given], y[given]
                if not len(x):
                    continue
                if len(x) <= DENSE * (len(p) + len(q)):
                    x, y = p[x].tolist(), q[y].tolist()
                    n = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                         *[pa.array([f(v[a], v[b]) for a, b in zip(x, y)], pa.binary()) for f in (max, min)]],
                        ["tile", "place", "a", "b"])
                    continue
                chosen = np.zeros((len(p), len(q)), bool)
                chosen[x, y] = True
                at = np.r_[np.unique(x), COMPARE + np.unique(y)]
                tile = mix64(mix64(mix64(meet) + np.uint64(i)) + np.uint64(j)).view(np.int64)
                masks = [np.packbits(chosen[k]).tobytes() if k < COMPARE else None for k in at.tolist()]
                ids = [v[p[k]] if k < COMPARE else v[q[k - COMPARE]] for k in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(tile, len(at))), pa.array(at, pa.int32()), pa.array(ids, pa.binary()),
                     pa.array(masks, pa.binary())], ["tile", "place", "a", "b"])


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    code, owner = (np.cumsum(several) - 1)[code[several[code]]], owner[several[code]]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(several.sum()), COLUMNS):
        i, k = np.searchsorted(code, (lo, lo + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[i:k], code[i:k] - lo] = 1
        out += (held[:len(left)] @ held[len(left):].T).astype(np.int64)
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the tiles (rows come sorted by tile) whose full sets are similar, as a
    forest: a link that joins what the tile's other links join is left out."""
    for group in _runs(batches, "tile"):
        place, v, masks = (group.column(c).to_pylist() for c in ("place", "v", "mask"))
        sets = [s for block in byte_blocks(group.to_batches(), "text", BLOCK) for s in shingle_sets(block.column("text"))]
        left = [i for i, k in enumerate(place) if k < COMPARE]
        right = [i for i, k in enumerate(place) if k >= COMPARE]
        at = np.array([place[i] - COMPARE for i in right])
        chosen = np.array([np.unpackbits(np.frombuffer(masks[i], np.uint8))[at] for i in left], bool)
        both = _common([sets[i] for i in left], [sets[i] for i in right])
        sizes = np.array([len(s) for s in sets])
        chosen &= 100 * both >= SIMILAR * (sizes[left][:, None] + sizes[right][None, :] - both)
        top: dict[bytes, bytes] = {}
        found = []
        for x, y in zip(*(k.tolist() for k in np.nonzero(chosen))):
            ends = [v[left[x]], v[right[y]]]
            roots = []
            for end in ends:
                while end in top:
                    end = top[end]
                roots.append(end)
            if roots[0] != roots[1]:
                top[max(roots)] = min(roots)
                found.append((max(ends), min(ends)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Which blocks of the split buckets are compared: key, own, block, meet, side.

    A component of over GROUP members of the bucket is dealt into blocks of its own
    (``own`` is its root), all smaller ones together (``own`` is empty), so that many
    members of one component do not multiply and are compared with the others only.
    """
    counts = rows.groupBy("key", "root").count()
    own = F.when(F.col("count") > GROUP, F.col("root")).otherwise(F.lit(b""))
    blocks = counts.groupBy("key", own.alias("own")).agg(F.ceil(F.sum("count") / GROUP).cast("int").alias("blocks"))
    blocks = stage(blocks, "blocks")
    one = blocks.select("key", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    l, r = (one.select("key", *[F.col(c).alias(f"{c}_{i}") for c in ("own", "blocks", "block")]) for i in (1, 2))
    ahead = F.struct("own_1", "block_1") <= F.struct("own_2", "block_2")
    pairs = l.join(r, "key").filter(ahead & ((F.col("own_1") != F.col("own_2")) | (F.length("own_1") == 0)))
    pairs = pairs.withColumn("meet", F.xxhash64("key", "own_1", "block_1", "own_2", "block_2"))
    alone = (F.col("own_1") == F.col("own_2")) & (F.col("block_1") == F.col("block_2"))
    sides = F.when(alone, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    pairs = pairs.withColumn("side", F.explode(sides))
    of = [F.when(F.col("side") == 1, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1")).alias(c) for c in ("own", "blocks", "block")]
    return pairs.select("key", *of, "meet", "side")


def _left_pairs(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different components that share an open bucket and are near by their
    signatures, as ``_compare`` gives them.  A bucket of over GROUP members is dealt into blocks of about GROUP,
    and each block is compared with each in a task of its own.
    """
    rows = stage(placed.join(_open_buckets(placed), "key"), "open_members")

    @F.pandas_udf("binary")
    def marks(bands: pd.Series) -> pd.Series:  # the low halves of the band keys
        return pd.Series([np.asarray(b, np.int64).astype(np.uint32).tobytes() for b in bands])

    known = stage(rows.select("v").distinct().join(classes.withColumnRenamed("set_id", "v"), "v")
                  .select("v", "print", marks("bands").alias("marks"), "n_shingles"), "left_marks")
    columns = ["meet", "side", "band", "v", "root"]
    whole = rows.filter(F.col("n") <= GROUP).withColumn("meet", F.col("key")).withColumn("side", F.lit(2)).select(columns)
    large = rows.filter(F.col("n") > GROUP)
    pairs = stage(_block_pairs(large), "block_pairs")
    big = pairs.filter(F.length("own") > 0).select("key", F.col("own").alias("root")).distinct()
    large = large.join(big.withColumn("own", F.col("root")), ["key", "root"], "left").withColumn("own", F.coalesce("own", F.lit(b"")))
    # a member meets the tasks of its own block and no others
    block = F.pmod(F.xxhash64(F.lit(7), "v"), F.col("blocks")).cast("int")
    dealt = large.join(pairs.select("key", "own", "blocks").distinct(), ["key", "own"]).withColumn("block", block)
    parts = dealt.join(pairs.drop("blocks"), ["key", "own", "block"]).select(columns)
    left = whole.union(parts).join(known, "v").repartition("meet").sortWithinPartitions("meet")
    return stage(left.mapInArrow(_compare, "tile long, place int, a binary, b binary"), "left")


def _left_links(left: DataFrame, tried: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among ``left``: single pairs are confirmed as such, a crowded tile in one
    task that gets each text once."""
    pairs = stage(left.filter("tile is null").select("a", "b").join(tried, ["a", "b"], "left_anti"), "tried")
    tiles = (left.filter("tile is not null").select("tile", "place", F.col("a").alias("v"), F.col("b").alias("mask"))
             .join(texts.withColumnRenamed("set_id", "v"), "v").repartition("tile").sortWithinPartitions("tile"))
    return _confirmed(pairs, texts).union(tiles.mapInArrow(_settle, "a binary, b binary"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept.

    Two texts are linked when they share at least SIMILAR per cent of the union of
    their sets; component_id is the smallest doc_id that links lead to.  Null and
    empty texts and texts of white space have the empty set and are linked with
    nothing.  Null ids count for nothing in a component; a component of null ids has
    a null id and keeps all its rows.  Rows that repeat the smallest id are all
    kept.  An empty table gives an empty result; other columns are ignored.
    """
    rows = _signed(docs)
    classes = (rows.filter(F.col("set_id").isNotNull()).groupBy("set_id")
               .agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("print").alias("print"),
                    F.first("n_shingles").alias("n_shingles")))
    classes = stage(classes, "classes")
    spread = classes.select(F.col("set_id").alias("v"), F.posexplode("bands").alias("band", "key"))
    shared = stage(spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared_buckets")
    buckets = stage(spread.join(shared, "key").select("key", "band", "v"), "buckets")
    found = _linked(docs, classes, buckets)
    first = (classes.select("set_id", "first_id").join(found, F.col("set_id") == F.col("vertex"), "left")
             .select("set_id", "first_id", F.coalesce("root", "set_id").alias("root")))
    least = stage(first.groupBy("root").agg(F.min("first_id").alias("component_id")), "component_ids")
    known = stage(first.join(least, "root").select("set_id", "component_id"), "class_components")
    grouped = rows.filter(F.col("set_id").isNotNull()).join(known, "set_id").select(
        "doc_id", "text_hash", "n_shingles", "component_id")
    empty = rows.filter(F.col("set_id").isNull()).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns whatever these are called, that
    ``near_groups`` keeps: null and empty texts, null ids and repeated rows as it says.

    A Bloom filter over the dropped rows lets all others pass straight through; only
    rows that may be dropped are joined with the dropped ones, so few texts move.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text_hash())
    dropped = stage(near_groups(docs).filter(~F.col("kept")).select("doc_id", "text_hash").distinct(), "near_copies")
    hashes = dropped.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text_hash").alias("h"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bloom.build(hashes, dropped.count()))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        slots = bloom.hash_slots(h.to_numpy(np.int64).view(np.uint64), len(bitmap.value) * 8)
        return pd.Series(bloom.has(bitmap.value, slots).all(axis=1))

    of_id, of_text = free_names(docs, "near_dup_id", "near_dup_text")
    gone = dropped.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_text))
    same = docs["doc_id"].eqNullSafe(F.col(of_id)) & (F.xxhash64(docs["text"]) == F.col(of_text))
    return docs.filter(~maybe(key)).unionByName(docs.filter(maybe(key)).join(gone, same, "left_anti"))


def _linked(docs: DataFrame, classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """vertex and root of all classes that a confirmed link joins to another."""
    spark = docs.sparkSession
    members = stage(buckets.select("v").distinct(), "candidates")
    wanted = stage(members.join(classes, F.col("v") == F.col("set_id")).select(
        "set_id", F.col("first_id").alias("doc_id")), "wanted")
    texts = _texts_of(docs, wanted)
    # first every class against the smallest class that it meets anywhere
    pivots = stage(buckets.groupBy("key").agg(F.min("v").alias("pivot")), "pivots")
    first = (buckets.join(pivots, "key").groupBy(F.col("v").alias("a")).agg(F.min("pivot").alias("b")).filter("a > b"))
    first = stage(first, "tried")
    links, tried = stage(_confirmed(first, texts), "confirmed"), first
    hardly_any = HARDLY_ANY * members.count()
    last = False
    for attempt in range(1, STAR_ROUNDS + 2):
        found = stage(components(links), "components")
        if last:
            return found
        placed = stage(buckets.join(found.withColumnRenamed("vertex", "v"), "v", "left").select(
            "key", "band", "v", F.coalesce("root", "v").alias("root")), "placed")
        pairs = _star_pairs(placed, attempt)
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        new = stage(_confirmed(pairs, texts), "confirmed")
        links, tried = links.union(new), tried.union(pairs)
        if attempt == STAR_ROUNDS or new.count() <= hardly_any:
            found = stage(components(links), "components")
            placed = buckets.join(found.withColumnRenamed("vertex", "v"), "v", "left").select(
                "key", "band", "v", F.coalesce("root", "v").alias("root"))
            left = _left_links(_left_pairs(stage(placed, "placed"), classes), tried, texts)
            links, last = links.union(stage(left, "confirmed")), True
    return stage(components(links), "components")
