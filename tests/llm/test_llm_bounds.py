"""What a verdict found at the edges: bounds, clashes, stored maps, rules without tokens,
secrets behind their signs, several benchmark blocks."""

import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus import BENCH_WORD, LOWER, corpus, frame, multiset, sentence  # noqa: E402

from tidemark.llm import decontaminate, near_dup, pii, quality, sharding, url_filter  # noqa: E402
from tidemark.llm.queries import benchmark_hits as query_hits  # noqa: E402
from tidemark.session import scratch_path, ship_package  # noqa: E402
from tidemark.sources import versions  # noqa: E402


# --- quality ------------------------------------------------------------------------

def test_training_rows_are_bounded_after_the_join(spark, monkeypatch):
    """Many rows of few ids: no more than ``sample_rows`` reach the driver."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    docs = spark.range(6000).select((F.col("id") % 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(7).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    quality.train(docs, labels, sample_rows=50)
    quality.train(docs.repartition(5), labels, sample_rows=50)
    assert [len(y) for _, y in seen] == [50, 50]
    assert np.array_equal(seen[0][0], seen[1][0]) and np.array_equal(seen[0][1], seen[1][1])


def test_table_scores_are_sums_of_bins():
    """A scorer that looks every table up cell by cell gives the same scores."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    x[:40] = np.round(x[:40])  # ties with edges
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y)
    for row, score in zip(x, model.scores(x)):
        cell = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        z = model.intercept + sum(t[c] for t, c in zip(model.tables, cell))
        z += sum(t[cell[i] // quality.COARSE, cell[j] // quality.COARSE] for i, j, t in model.pairs)
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-9
    assert len(model.pairs) == 6


def _gain(parts) -> float:
    return sum(g * g / (h + 1) for g, h in parts)


def test_trees_take_the_best_cuts():
    """Every first cut of a feature's tree and every cross of a pair's, tried one by one."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        g, h = rng.normal(size=9), rng.random(9)
        table = quality._step(g, h)
        cuts = [k for k in range(1, 9) if not np.isclose(table[k], table[k - 1])]
        gains = {k: _gain([(g[:k].sum(), h[:k].sum()), (g[k:].sum(), h[k:].sum())]) for k in range(1, 9)}
        best = max(gains, key=gains.get)
        if gains[best] <= _gain([(g.sum(), h.sum())]):  # no cut is worth it
            assert not table.any()
            continue
        assert best in cuts and len(cuts) <= 2
        for lo, hi in zip([0, *cuts], [*cuts, 9]):
            assert np.allclose(table[lo:hi], g[lo:hi].sum() / (h[lo:hi].sum() + 1))
        g, h = rng.normal(size=(5, 6)), rng.random((5, 6))
        gain, table = quality._pair_step(g, h)
        crosses = {}
        for r in range(1, 5):
            for c in range(1, 6):
                quarters = [(x[:r, :c], x[:r, c:], x[r:, :c], x[r:, c:]) for x in (g, h)]
                crosses[r, c] = _gain([(a.sum(), b.sum()) for a, b in zip(*quarters)])
        r, c = max(crosses, key=crosses.get)
        assert np.isclose(gain, crosses[r, c])
        assert np.allclose(table[:r, c:], g[:r, c:].sum() / (h[:r, c:].sum() + 1))


# --- near copies --------------------------------------------------------------------

def test_keep_one_with_any_column_names(spark):
    rows = corpus()
    plain = near_dup.keep_one(frame(spark, rows)).select("doc_id", "text")
    named = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in (
        "near_dup_id", "near_dup_text", "_near_dup_id", "set_id", "key", "root", "text_hash", "block", "meet")})
    got = near_dup.keep_one(named)
    assert got.columns == named.columns
    assert multiset(got.select("doc_id", "text").collect()) == multiset(plain.collect())
    assert {r[0] for r in got.select("near_dup_id").distinct().collect()} == {"own near_dup_id"}


# --- shard maps ---------------------------------------------------------------------

def test_a_later_run_keeps_to_the_stored_map(spark):
    maps = scratch_path(spark, "test_maps")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    placed, first = sharding.shard(docs, 8, slots=64, maps=maps)
    where = {r.doc_id: r.shard for r in placed.collect()}
    more = docs.union(spark.range(3000, 9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), F.lit(500)).alias("text")))
    again, second = sharding.shard(more, 8, slots=64, maps=maps)
    assert second == first and sharding.load_map(spark, maps) == first and len(versions.history(spark, maps)) == 1
    assert {r.doc_id: r.shard for r in again.filter("doc_id < 3000").collect()} == where
    grown, third = sharding.shard(more, 9, slots=64, maps=maps)  # another shard: the stored map is edited
    assert third.version == 2 and sharding.load_map(spark, maps) == third and sharding.load_map(spark, maps, 1) == first
    assert {(a, b) for a, b in zip(first.owner, third.owner) if a != b} == {(a, 8) for a, b in zip(first.owner, third.owner) if a != b}
    assert {r.shard for r in grown.filter("virtual_slot >= 0").select("shard").distinct().collect()} == set(range(9))
    assert sharding.load_map(spark, maps, 7) is None and sharding.load_map(spark, scratch_path(spark, "none")) is None
    with pytest.raises(ValueError):
        sharding.shard(docs, 8, slots=32, maps=maps)


# --- URL rules ----------------------------------------------------------------------

def test_rules_without_ascii_or_any_token(spark):
    rules = [url_filter.host_rule("block", "пример.рф/"), url_filter.host_rule("block", "com/dé"), url_filter.word_rule("größe"),
             url_filter.Rule("digits", r"[0-9]{5}", (), "block", 5), url_filter.host_rule("allow", "com/")]
    urls = ["http://пример.рф/", "http://a.пример.рф/x?y", "http://непример.рф/", "http://x.com/dé", "http://x.com/déjà", "http://x.com/de",
            "http://x.größe.org/", "http://großes.org/", "http://a.net/12345", "http://a.net/1234", "http://b.com/99999", None, "", "nothing",
            "http://" + "x" * 50_000 + ".рф/11111"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: (r.verdict, r.matched) for r in url_filter.judge(pages, rules).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("block", "пример.рф/"), ("block", "пример.рф/"), ("allow", None), ("block", "com/dé"), ("block", "com/dé"), ("allow", "com/"),
        ("block", "größe"), ("allow", None), ("block", "digits"), ("allow", None), ("allow", "com/"), ("allow", None), ("allow", None),
        ("allow", None), ("block", "digits")]
    index = {r.name: r.token for r in url_filter.rule_index(spark, pages.limit(0).withColumn("target", F.lit("")), rules).collect()}
    assert set(index) == {"пример.рф/", "com/dé", "größe", "com/"}


def test_thousands_of_rules(spark):
    """Judged as a loop over all rules does; urls without a rule's token are not joined."""
    rng = random.Random(4)
    host = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(400)}.{rng.choice(['com', 'org', 'net'])}"
    rules = list({r: url_filter.host_rule(rng.choice(["allow", "block"]), r) for r in
                  (f"{host()}/{rng.choice(['', 'x', 'x/', 'news/1'])}" for _ in range(3000))}.values())
    urls = [f"https://{rng.choice(['', 'www.'])}{host()}/{rng.choice(['', 'x', 'xy', 'x/1', 'news/12', 'q?x'])}" for _ in range(800)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.matched for r in url_filter.judge(pages, rules).collect()}
    patterns = [(r.rank, r.name, re.compile(r.pattern)) for r in rules]
    for i, u in enumerate(urls):
        target = re.sub(r"\?.*", "", u.split("://", 1)[1])
        fits = [(rank, name) for rank, name, pattern in patterns if pattern.search(target)]
        assert got[i] == (max(fits)[1] if fits else None)


# --- personal data ------------------------------------------------------------------

@pytest.mark.parametrize("text,value", [
    ('token = "f95017526fc608ad71587f8ea5418b66ff2e6d38" x', "f95017526fc608ad71587f8ea5418b66ff2e6d38"),
    ("TOKEN = 'F95017526FC608AD'", "F95017526FC608AD"), ("password: hunter22", "hunter22"), ("Password:\t\"secretive\"", "secretive"),
    ("api_key=abcd", "abcd"), ("my_access_key  =  AK12/+ab", "AK12/+ab"), ("secret: the prose goes on", None), ("token of love", None),
    ("password = abc", None), ("token\n= abcdef12", None), ("pwd:x1", None), ("passphrase=é€𝒳z; end", "é€𝒳z"),
])
def test_secrets_behind_blanks_signs_and_quotes(text, value):
    found = [(text[s:e]) for k, s, e in pii.find_spans(text, pii.automaton()) if k == "secret"]
    assert found == ([] if value is None else [value])


def test_planted_secrets_are_spanned(spark):
    """Every quoted 40-digit hexadecimal value of the documents that follows a cue."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {(r.doc_id, s.start, s.end) for r in pii.personal_data(rows).collect() for s in r.spans if s.kind == "secret"}
    planted = {(r.doc_id, m.start(1), m.end(1)) for r in rows.collect() if r.text
               for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    assert planted and len(planted & found) >= 0.9 * len(planted)


# --- benchmark ----------------------------------------------------------------------

def proximate(rows, items, slop, width=13) -> dict:
    """doc_id -> number of items with a window all of whose words stand within ``slop`` of
    their places for some start."""
    out = {}
    for r in rows:
        w = BENCH_WORD.findall((r[1] or "").translate(LOWER))
        near = set()
        for item, text in items:
            b = BENCH_WORD.findall((text or "").translate(LOWER))
            for i in range(max(1, len(b) - width + 1) if b else 0):
                win = b[i:i + width]
                if any(all(any(0 <= p < len(w) and w[p] == x for p in range(at + k - slop, at + k + slop + 1)) for k, x in enumerate(win))
                       for at in range(-slop, len(w) + slop)):
                    near.add("" if item is None else str(item))
        out[r[0]] = len(near)
    return out


def test_query_counts_proximity_matches(spark, tmp_path):
    rng = random.Random(6)
    rows, items = [], []
    for i in range(12):
        b = sentence(rng, rng.choice([5, 14, 20])).split()
        items.append((f"i{i}", " ".join(b)))
        moved = list(b)
        moved.insert(rng.randrange(len(moved)), "new")
        for j, text in enumerate((b, moved, moved[1:], b[::-1], ["x"] * 20 + b[2:])):
            rows.append((len(rows), " ".join(text), "en", "a", 0))
    rows += [(500, None, "en", "a", 0), (501, "", "en", "a", 0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items + [(None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_near, r.n_items) for r in query_hits(spark, str(tmp_path)).collect()}
    want = proximate(rows, items, decontaminate.SLOP)
    assert {k: v[0] for k, v in got.items()} == want
    assert any(near > exact for near, exact in got.values()) and all(near >= exact for near, exact in got.values())


def test_several_blocks_of_unstable_rows(spark):
    """Rows from a plan that deals them out anew at every run are still the same rows."""
    rng = random.Random(8)
    items = [(f"i{i}", sentence(rng, 15)) for i in range(30)]
    rows = [(i % 5, f"{sentence(rng, 4)} {items[i % 30][1]} {sentence(rng, 4)} {items[(i * 7) % 30][1]}", "en", "a", 0) for i in range(60)]
    docs = frame(spark, rows, clashes=True).withColumn("row", F.lit("own")).orderBy(F.rand()).repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find(docs, bench, block_bytes=200).collect()
    assert len(got) == 60
    one = decontaminate.find(frame(spark, rows), bench).collect()
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, tuple(r["items"]))
    assert sorted(map(key, got)) == sorted(map(key, one))
    clean = rows + [(900, sentence(rng, 50), "en", "a", 0), (901, None, "en", "a", 0)]
    kept = decontaminate.clean(frame(spark, clean, clashes=True).withColumns({"row": F.lit("r"), "contaminated_row": F.lit(1)}),
                               bench, block_bytes=200)
    assert sorted(r.doc_id for r in kept.collect()) == [900, 901] and "row" in kept.columns and "contaminated_row" in kept.columns


# --- token counts -------------------------------------------------------------------

def test_many_long_words_are_not_all_held(spark, monkeypatch):
    """Distinct words that share a long prefix make few nodes: the store of counts is
    emptied by its own size, and no count changes."""
    from tidemark.llm import token_counts
    rows = [(i, " ".join("q" * 60 + str(i * 50 + j) for j in range(50)), "en", "a", 0) for i in range(40)]
    docs = frame(spark, rows).coalesce(1)
    want = token_counts.token_counts(docs).collect()
    monkeypatch.setattr(token_counts, "MAX_HELD", 10_000)
    monkeypatch.setattr(token_counts, "MAX_NODES", 1 << 30)
    assert multiset(token_counts.token_counts(docs).collect()) == multiset(want)


# --- repeated passages --------------------------------------------------------------

def test_bucket_identifiers_are_exact():
    """Equal identifiers for equal bytes and for no others, at every width on the way."""
    import pyarrow as pa

    from tidemark.llm import suffix_dedup
    rng = random.Random(2)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.choice([30, 70]))) for _ in range(6)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 6))) for _ in range(40)] + ["é" * 60, "a" * 300]
    table = pa.table({"part": pa.array([0] * len(texts), pa.int32()), "doc_id": pa.array(range(len(texts)), pa.int64()),
                      "text": pa.array(texts)})
    part = suffix_dedup.Part(table, suffix_dedup.Plan(1, 6, 0, 2))
    at = np.concatenate([np.arange(a, b - 49) for a, b in zip(part.offsets, part.offsets[1:])])
    raw = part.data.tobytes()
    for width in (8, 24, 50):
        found = part._buckets(at, width)
        assert len(set(zip(found.tolist(), (raw[i:i + width] for i in at.tolist())))) == len(set(found.tolist())) == len(
            {raw[i:i + width] for i in at.tolist()})
    rare = np.sort(np.random.default_rng(1).choice(at, 50, replace=False))  # places that are not neighbours
    assert len(set(part._buckets(rare, 50).tolist())) == len({raw[i:i + 50] for i in rare.tolist()})


def test_a_collision_of_names_removes_nothing():
    """Strings of different bytes whose 64-bit names are forced to be equal stay apart."""
    import pyarrow as pa

    from tidemark.llm import suffix_dedup
    names, tails = [7, 7, 7], [1, 2, 1]
    table = pa.table({"bucket": pa.array([0] * 3, pa.int32()), "part": pa.array([0, 1, 2], pa.int32()),
                      "pointers": [np.array([n], "<u8").tobytes() for n in names],
                      "more": [np.array([t], "<u4").tobytes() for t in tails],
                      "ids": [np.array([i], "<u8").tobytes()[:2] for i in (5, 6, 9)]})
    *_, answer_strings, _ = suffix_dedup._steps(suffix_dedup.Plan(3, 6, 0, 2))
    assert answer_strings(table).column("part").to_pylist() == [2]  # 9 repeats 5; 6 is another string


# --- memory of workers --------------------------------------------------------------

def test_batches_to_workers_are_bounded_by_bytes(spark):
    """Long texts go to a worker in batches of some MB, not 10,000 rows at once."""
    ship_package(spark)
    docs = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("text "), 2000).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    seen = docs.mapInArrow(run, "size long, n long").collect()
    assert sum(r["n"] for r in seen) == 2000
    assert max(r["size"] for r in seen) <= 6 << 20


def test_texts_of_a_tile_are_cut_block_by_block(monkeypatch):
    """A crowded tile is settled alike when its texts are hashed a few at a time."""
    words = sentence(random.Random(1), 60).split()
    texts = [" ".join(words[:50 + i]) for i in range(6)]
    place = [0, 1, 2, near_dup.COMPARE, near_dup.COMPARE + 1, near_dup.COMPARE + 2]
    group = pa.RecordBatch.from_arrays(
        [pa.array([1] * 6), pa.array(place, pa.int32()), pa.array([b"%d" % i for i in range(6)]),
         pa.array([np.packbits([1, 1, 1]).tobytes()] * 3 + [None] * 3, pa.binary()), pa.array(texts)],
        ["tile", "place", "v", "mask", "text"])
    seen, real = [], near_dup.shingle_sets
    monkeypatch.setattr(near_dup, "shingle_sets", lambda t: seen.append(len(t)) or real(t))
    whole = [b.to_pylist() for b in near_dup._settle(iter([group]))]
    monkeypatch.setattr(near_dup, "BLOCK", 500)
    assert [b.to_pylist() for b in near_dup._settle(iter([group]))] == whole and whole
    assert len(seen) > 2 and max(seen[1:]) < 6
