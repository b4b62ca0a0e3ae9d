"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import os
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus import corpus, frame, multiset, near_components, removed_bytes  # noqa: E402

from tidemark.llm import bloom, exact_dedup, near_dup, suffix_dedup  # noqa: E402


@pytest.mark.parametrize("bits", [16, 1])
def test_exact_groups(spark, bits):
    rows = corpus()
    got = exact_dedup.exact_groups(frame(spark, rows, clashes=True), bits_per_row=bits).collect()
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in by_text.items()}
    want = [(i, hashlib.sha256((t or "").encode()).hexdigest(), keep[t or ""], len(by_text[t or ""]), i == keep[t or ""])
            for i, t, *_ in rows]
    assert multiset((r.doc_id, r.digest.hex(), r.keep_id, r.group_size, r.kept) for r in got) == multiset(want)


def test_exact_groups_full_filter(spark):
    """A filter far too small lets rows into the shuffle and changes nothing."""
    rows = [(i, f"text {i % 3000}", "en", "a", 0) for i in range(4000)]
    got = exact_dedup.exact_groups(frame(spark, rows), max_filter_bytes=1).collect()
    assert sum(r.kept for r in got) == 3000 and len(got) == 4000
    assert all(r.keep_id == (r.doc_id % 3000 + 3000 if r.doc_id % 3000 < 1000 else r.doc_id) for r in got)


def test_only_possible_copies_are_grouped(spark):
    rows = [(i, f"text {i}", "en", "a", 0) for i in range(2000)] + [(5000, "text 7", "en", "a", 0)]
    docs = frame(spark, rows)
    from pyspark.sql import functions as F
    digests = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    bitmap = exact_dedup.repeated_filter(digests, 2001, 16, 1 << 20)
    slots = exact_dedup._slots(pa.array([bytes(r.digest) for r in digests.collect()]), len(bitmap) * 8)
    flagged = bloom.has(bitmap, slots).all(axis=1)
    assert flagged[7] and flagged[2000] and flagged.sum() < 40


def test_near_groups(spark):
    rows = corpus()
    got = near_dup.near_groups(frame(spark, rows, clashes=True)).collect()
    want = near_components(rows)
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got) == multiset(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("group", [4096, 12, 1])
def test_open_buckets_are_compared(spark, monkeypatch, group):
    """Chains of near copies around the threshold, with whole, mixed and split buckets."""
    import random
    from corpus import sentence
    monkeypatch.setattr(near_dup, "GROUP", group)
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 1)
    rng = random.Random(3)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            copy[rng.randrange(len(copy))] = sentence(rng, 1)
        rows.append((i, " ".join(copy), "en", "a", 0))
    got = near_dup.near_groups(frame(spark, rows)).collect()
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got) == multiset(near_components(rows))


def test_superminhash_estimates():
    """Estimates are unbiased and vary less than those of independent minima."""
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (60, 20, 20))
        a, b = near_dup.superminhash([np.r_[both, one], np.r_[both, two]])
        errors.append((a == b).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < np.sqrt(0.6 * 0.4 / near_dup.PLACES)


def test_estimate_cut_misses_no_more_than_bands():
    """Of pairs at the threshold the cut by the estimate loses fewer than the bands do."""
    from math import comb
    share, places = near_dup.SIMILAR / 100, near_dup.PLACES
    under = sum(comb(places, k) * share ** k * (1 - share) ** (places - k) for k in range(places + 1) if k / places < near_dup.NEAR)
    assert under <= (1 - share ** near_dup.ROWS) ** (near_dup.BANDED // near_dup.ROWS)


def test_superminhash_early_stop_is_exact():
    """Signatures do not depend on which texts are signed together."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 3, 40, 900, 5000)]
    together = near_dup.superminhash(sets)
    for s, row in zip(sets, together):
        assert (near_dup.superminhash([s])[0] == row).all()
    merged = np.minimum(near_dup.superminhash([sets[5][:2500]]), near_dup.superminhash([sets[5][2500:]]))
    assert (merged[0] == together[5]).all()
    # one shingle's values are a permutation of the places
    assert sorted((together[1] >> np.uint64(48)).tolist()) == list(range(near_dup.PLACES))


def test_repeated_passages(spark):
    rows = corpus()
    got = suffix_dedup.repeated_passages(frame(spark, rows, clashes=True)).collect()
    want = removed_bytes(rows)
    assert multiset((r.doc_id, r.n_bytes, sum(x.e - x.s for x in r.removed), len(r.removed), r.kept_sha256)
                    for r in got) == multiset(want)


def test_repeated_passages_at_borders(spark):
    """Strings of 49, 50 and 51 bytes, passages side by side, inside one text, and cut
    characters; documents in one part and in many."""
    import random
    from corpus import sentence
    rng = random.Random(9)
    p, q = sentence(rng, 40)[:50], sentence(rng, 40)[:51]
    texts = [p, q, "x" + p + "y", p[:49], p + q, q + p + p, "é" * 30, "zé" * 20 + "é" * 30, p + "a" + p, (p + q) * 4]
    for spread in (1, 700):
        rows = [(i * spread, t, "en", "a", 0) for i, t in enumerate(texts)] + [(-5, "b" + q, "en", "a", 0)]
        rows += [(1000 + i, sentence(rng, 3000), "en", "a", 0) for i in range(spread // 100)]
        got = suffix_dedup.repeated_passages(frame(spark, rows)).collect()
        assert multiset((r.doc_id, r.n_bytes, sum(x.e - x.s for x in r.removed), len(r.removed), r.kept_sha256)
                        for r in got) == multiset(removed_bytes(rows))


def test_one_text_shuffle_serves_all_steps(spark):
    found = suffix_dedup.repeated_passages(frame(spark, corpus()))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 3


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, near_dup.near_groups, suffix_dedup.repeated_passages])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []
    assert len(run(frame(spark, [(1, None, None, None, None)])).collect()) == 1


@pytest.mark.parametrize("one_task", [1000, 0])
def test_components(spark, one_task):
    """Chains, stars, rings and random links, by union-find in one task and by rounds."""
    import random
    from tidemark.llm.components import components
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += [(rng.randrange(300, 380), rng.randrange(300, 380)) for _ in range(60)] + [(5, 5)]
    parent = {v: v for e in links for v in e}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    key = {v: v.to_bytes(4, "big") for v in parent}
    edges = spark.createDataFrame([(bytearray(key[a]), bytearray(key[b])) for a, b in links], "a binary, b binary").repartition(3)
    got = {bytes(r.vertex): bytes(r.root) for r in components(edges, one_task).collect()}
    assert got == {key[v]: key[top(v)] for v in parent if sum(top(u) == top(v) for u in parent) > 1}
    assert components(edges.limit(0), one_task).collect() == []

def test_split_bucket_pair_of_one_band(spark, monkeypatch):
    """A near pair that shares one band only is compared in a bucket of any size."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(near_dup, "GROUP", 3)
    rng = np.random.default_rng(4)
    bands = near_dup.BANDED // near_dup.ROWS
    prints = rng.integers(0, 256, (20, near_dup.PLACES), dtype=np.uint8)
    prints[7, :200] = prints[3, :200]
    keys = rng.integers(0, 1 << 62, (20, bands))
    keys[:, 5] = 99
    classes = spark.createDataFrame([(bytes([i]) * 16, k.tolist(), p.tobytes(), 100) for i, (k, p) in enumerate(zip(keys, prints))],
                                    "set_id binary, bands array<long>, print binary, n_shingles long")
    placed = classes.select(F.lit(99).cast("long").alias("key"), F.lit(5).alias("band"), F.col("set_id").alias("v"),
                            F.when(F.col("set_id") < bytes([5]), F.lit(bytes(16))).otherwise(F.col("set_id")).alias("root"))
    got = [(r.a[0], r.b[0]) for r in near_dup._left_pairs(placed, classes).collect()]
    assert got == [(7, 3)]


def test_crowded_buckets_give_no_list_of_pairs(spark):
    """Copies of one template under the threshold: rows grow with members, not pairs."""
    rng = np.random.default_rng(6)
    bands = near_dup.BANDED // near_dup.ROWS
    n = 300
    keys, prints = np.full((n, bands), 7), np.full((n, near_dup.PLACES), 3, np.uint8)
    prints[:, 180:] = rng.integers(0, 256, (n, near_dup.PLACES - 180))
    classes = spark.createDataFrame([(i.to_bytes(16, "big"), k.tolist(), p.tobytes(), 100) for i, (k, p) in enumerate(zip(keys, prints))],
                                    "set_id binary, bands array<long>, print binary, n_shingles long")
    from pyspark.sql import functions as F
    placed = classes.select(F.lit(7).cast("long").alias("key"), F.lit(0).alias("band"), F.col("set_id").alias("v"),
                            F.col("set_id").alias("root"))
    assert near_dup._left_pairs(placed, classes).count() <= 4 * n


def test_tiles_are_settled_on_full_sets(spark):
    """Tiles of crowded buckets give the links of brute force, joined or not."""
    from corpus import shingles
    from pyspark.sql import functions as F
    import random
    from corpus import sentence
    rng = random.Random(9)
    base = sentence(rng, 150).split()
    texts = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.choice([2, 4, 6, 8])):
            copy[rng.randrange(len(copy))] = f"own{rng.random()}"
        texts.append(" ".join(copy))
    sets = near_dup.shingle_sets(pa.array(texts))
    common = near_dup._common(sets[:15], sets[15:])
    want = [[len(shingles(a) & shingles(b)) for b in texts[15:]] for a in texts[:15]]
    assert common.tolist() == want
    rows = [(5, i if i < 15 else near_dup.COMPARE + i - 15, bytes([i]), np.packbits(np.ones(25, bool)).tobytes() if i < 15 else None, t)
            for i, t in enumerate(texts)]
    tiles = spark.createDataFrame(rows, "tile long, place int, v binary, mask binary, text string").coalesce(1)
    got = [(r.a[0], r.b[0]) for r in tiles.sortWithinPartitions("tile").mapInArrow(near_dup._settle, "a binary, b binary").collect()]
    near = {(j + 15, i) for i in range(15) for j in range(25)
            if 100 * want[i][j] >= 75 * (len(sets[i]) + len(sets[j + 15]) - want[i][j])}

    def parts(links):
        top = list(range(40))
        for a, b in links:
            top = [top[a] if t == top[b] else t for t in top]
        return {frozenset(i for i in range(40) if top[i] == t) for t in top}

    assert near and set(got) <= near and parts(got) == parts(near) and len(parts(near)) > 1
