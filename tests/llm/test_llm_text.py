"""Quality, token counts, benchmark hits and personal data."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus import benchmark_hits, corpus, frame, multiset, sentence, words  # noqa: E402

from tidemark.llm import decontaminate, pii, quality, token_counts  # noqa: E402

SF = "/root/testdata/sf0.01"


# quality

def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98


def test_scores_of_awkward_texts(spark):
    rows = corpus()
    model = quality.fit(np.random.default_rng(1).random((50, len(quality.FEATURES))), np.arange(50) % 2)
    docs = frame(spark, rows, clashes=True).drop("score")
    got = quality.with_scores(docs, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == set(docs.columns) | {"score"}
    assert all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1
    repeated = {r.score for r in got if r.text == rows[3][1]}
    assert len(repeated) == 1
    assert quality.with_scores(frame(spark, []), model).collect() == []


def test_features_do_not_depend_on_the_batch():
    import pyarrow as pa
    texts = [r[1] for r in corpus()[:-3]]
    together = quality.features(pa.array(texts))
    for t, row in zip(texts, together):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], row)


def test_fit_degenerate(spark):
    none = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert none.scores(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    ones = quality.fit(np.zeros((5, len(quality.FEATURES))), np.ones(5))
    assert ones.scores(np.zeros((1, len(quality.FEATURES))))[0] > 0.9
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score_documents(frame(spark, corpus()), labels).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == len(corpus())


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) != (x[:, 7] > 0.5)).astype(float)  # no feature tells anything alone
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert (2, 7) in {(i, j) for i, j, _ in model.pairs}


# token counts

def best_segmentation(model, word):
    """Plain dynamic programming over one word."""
    best = [(0, 0)]
    for i in range(1, len(word) + 1):
        options = [(best[s][0] + model.scores[word[s:i]], best[s][1] - 1) for s in range(i) if word[s:i] in model.scores]
        if word[i - 1] not in model.scores:
            n = len(word[i - 1].encode())
            options.append((best[i - 1][0] + n * model.byte_score, best[i - 1][1] - n))
        best.append(max(options))
    return -best[-1][1]


def test_trie_counts(spark, monkeypatch):
    rng = random.Random(2)
    pieces = {token_counts.MARK, *"abcdefghijk"} | {
        "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 5))) for _ in range(200)}
    pieces |= {token_counts.MARK + p for p in list(pieces)[:60]}
    model = token_counts.UnigramModel.of({p: -rng.randint(1, 9) * 1_000_000 for p in sorted(pieces)}, -12_000_000)
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 10_000]
    for nodes in (600_000, 50):  # a trie emptied often counts the same
        monkeypatch.setattr(token_counts, "MAX_NODES", nodes)
        got = token_counts.token_counts(frame(spark, rows, clashes=True), model).collect()
        want = [(r[0], len(words(r[1])), sum(best_segmentation(model, token_counts.MARK + w) for w in words(r[1])))
                for r in rows]
        assert multiset((r.doc_id, r.n_pretokens, r.n_tokens) for r in got) == multiset(want)
    assert token_counts.token_counts(frame(spark, []), model).collect() == []


def test_trie_shares_prefixes_and_deep_words():
    model = token_counts.load_model()
    trie = token_counts.PrefixTrie(model)
    for word in ("station", "stations", "stationary", "日本語", "x" * 500, ""):
        assert trie.count(token_counts.MARK + word) == best_segmentation(model, token_counts.MARK + word)
    before = len(trie)
    trie.count(token_counts.MARK + "stationed")
    assert len(trie) == before + 2


# benchmark

def _items(rows):
    rng = random.Random(8)
    text = " ".join(words(rows[20][1])[3:30]) + " Punctuation, and-hyphens: 12"
    return [(1, text), (10, text), (2, sentence(rng, 40)), (3, "two words"), (4, ""), (5, None), (6, "..."),
            (7, " ".join(words(rows[30][1])[:13])), (None, rows[25][1]), (8, "ONE")]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_benchmark_hits(spark, block):
    rows = corpus() + [(900, "x " + " ".join(words(corpus()[20][1])[3:30]).upper() + "!", "en", "a", 0)]
    items = _items(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(frame(spark, rows, clashes=True), bench, block_bytes=block).collect()
    want = benchmark_hits(rows, items)
    assert multiset((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == multiset(want)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    dirty = {i for i, n, h, _ in want if h and 20 * h >= n}
    kept = decontaminate.clean(frame(spark, rows), bench).collect()
    assert multiset(kept) == multiset(r for r, (i, n, h, _) in zip(rows, want) if not (h and 20 * h >= n))
    assert dirty


def test_proximity(spark):
    rng = random.Random(4)
    item = sentence(rng, 13).split()
    moved = item[:6] + ["extra"] + item[6:]
    swapped = [item[1], item[0], *item[2:]]
    far = item[:6] + sentence(rng, 9).split() + item[6:]
    rows = [(i, " ".join(w), "en", "a", 0) for i, w in enumerate([item, moved, swapped, far])]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find(frame(spark, rows), bench, slop=2).collect()}
    assert [got[i].n_hit for i in range(4)] == [13, 0, 0, 0]
    assert [len(got[i].near_items) for i in range(4)] == [1, 1, 1, 0]
    # the same whichever term is rare in the shard
    filler = [(10 + i, w, "en", "a", 0) for i, w in enumerate(item)] * 3
    for left_out in (0, 6, 12):
        docs = frame(spark, rows + [r for r in filler if r[1] != item[left_out]]).coalesce(1)
        near = {r.doc_id: len(r.near_items) for r in decontaminate.find(docs, bench, slop=2).collect()}
        assert [near[i] for i in range(4)] == [1, 1, 1, 0]


def test_benchmark_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = corpus()
    assert {r.n_hit for r in decontaminate.find(frame(spark, rows), none).collect()} == {0}
    assert decontaminate.clean(frame(spark, rows), none).count() == len(rows)
    assert decontaminate.find(frame(spark, []), none).collect() == []


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_base_spans_on_random_texts():
    anchors = pii.automaton()
    rng = random.Random(1)
    bits = ["1", "2", "5", "25", "0", ".", ".", "@", "+", " ", "-", "a", "b", "%", "(", ")", "\n", "é",
            "4111 1111 1111 1111", "٣", "password=", "iban", "://"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find_spans(text, anchors) if s[0] in pii.KINDS] == base_spans(text), text


def test_added_spans():
    anchors = pii.automaton()
    text = "IBAN: GB82 WEST 1234 5698 7654 32 http://me:pw@h.org/ Password=abcd1234, iban GB00 WEST 1234 5698 7654 32"
    assert [(k, text[s:e]) for k, s, e in pii.find_spans(text, anchors)] == [
        ("account", "GB82 WEST 1234 5698 7654 32"), ("credential", "me:pw"), ("email", "pw@h.org"),
        ("secret", "abcd1234")]


def test_personal_data_query_columns(spark):
    rows = corpus() + [(800, "é a.b@c.org and +1 (988) 555-2485 or 10.0.0.1 password=abcd", "en", "a", 0)]
    got = pii.digest_columns(pii.personal_data(frame(spark, rows, clashes=True))).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.doc_id == 800)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 1)
    assert one.spans == "email:2:11,phone:16:33,ip:37:45,secret:55:59"
    assert one.base_sha256 == hashlib.sha256(b"email:2:11,phone:16:33,ip:37:45").hexdigest()
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.doc_id != 800)
    assert pii.personal_data(frame(spark, [])).collect() == []
