"""Spelling variants, fill-in-the-middle and SimHash groups against brute force."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus import LOWER, corpus, frame, multiset, sentence, words  # noqa: E402

from tidemark.llm import fim, simhash, spelling  # noqa: E402
from tidemark.llm.queries import filled  # noqa: E402


# --- spelling ---------------------------------------------------------------------

def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(rows) -> list[tuple]:
    """Rows of ``variants``, all pairs of words compared."""
    import re
    counts = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    around = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


def spelling_rows() -> list[tuple]:
    """Words with dense neighbourhoods: repeated letters, edits at both ends, accents,
    chains of forms, equal counts."""
    rng = random.Random(3)
    words_ = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa", "éléments", "elements", "élément", "Éléments"]
    for _ in range(60):
        base = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 10)))
        words_.append(base)
        for _ in range(3):
            at, kind = rng.randrange(len(base) + 1), rng.randrange(3)
            c = rng.choice("abcé")
            words_.append(base[:at] + c + base[at + (kind > 0):] if kind else base[:max(at - 1, 0)] + base[at:])
    text = []
    for w in words_:
        text += [w if rng.random() < .5 else w.upper() if w.isascii() else w] * rng.choice([1, 5, 6, 30, 40, 200])
    text += ["chained"] * 700 + ["chaine"] * 5 + ["chainedd"] * 140 + ["chaineddd"] * 28 + ["×÷×÷×÷"] * 6
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::20]), "en", "a", 0) for i in range(20)]
    rows += [(None, "nullid " * 9, "en", None, 0), (20, None, "en", "a", 0), (21, "", "en", "a", 0), (22, "short", "en", "a", 0),
             (23, "lengthy, " * 50_000, "en", "a", 0), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("make", [spelling_rows, corpus])
def test_variants(spark, make):
    rows = make()
    got = spelling.variants(frame(spark, rows, clashes=True))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert multiset(got.collect()) == multiset(spelled(rows))


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None, "en", "a", 0)])).count() == 0


def test_every_edit_meets_in_the_index():
    """Each edit of a word shares a key, whichever of the two is looked up."""
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(6, 11)))
        others = {word[:i] + c + word[j:] for i in range(len(word) + 1) for c in ("", "a", "b", "c") for j in (i, i + 1)}
        others = {o for o in others if near(o, word) and len(o) >= 6}
        size = Counter(g for w in (word, *others) for g in {w[i:i + 2] for i in range(len(w) - 1)})
        size = {g: n * rng.randint(1, 3) for g, n in size.items()}
        rank = {g: i for i, g in enumerate(sorted(size, key=lambda g: (size[g], g)))}
        for other in others:
            met = False
            for a, b in ((word, other), (other, word)):
                (last_a, places_a), (last_b, places_b) = spelling.gram_prefix(a, rank), spelling.gram_prefix(b, rank)
                if last_a <= last_b:
                    met |= bool(set(spelling.pivot_keys(a, spelling.pivots(a, places_a, size))) & spelling.index_keys(b, places_b))
            assert met, (word, other)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(6, 12)))
        size = {a + b: rng.randint(1, 9) for a in "abcd" for b in "abcd"}
        rank = {g: i for i, g in enumerate(sorted(size, key=lambda g: (size[g], g)))}
        _, places = spelling.gram_prefix(word, rank)
        cost = lambda at: sum(size[word[i:i + 2]] for i in at)
        chosen = spelling.pivots(word, places, size)
        assert chosen[1] - chosen[0] >= 2 and set(chosen) <= set(places)
        assert cost(chosen) == min(cost(p) for p in combinations(places, 2) if p[1] - p[0] >= 2)


def test_common_grams_do_not_multiply(spark):
    """Words that share their first or last grams do not all meet: what meets stays in
    proportion to the words."""
    rng = random.Random(6)
    rows = [("qz" + "".join(rng.choice("abcdefgh") for _ in range(8)) + "zq", 9) for _ in range(4000)]
    df = spark.createDataFrame(sorted(set(rows)), "word string, n long")
    size = spelling.gram_sizes(df)
    schema = "key long, word string, n long, last int"
    asked = df.mapInArrow(spelling._keyed(size, index=False), schema)
    held = df.mapInArrow(spelling._keyed(size, index=True), schema)
    assert asked.join(held.select("key"), "key").count() < 40 * df.count()


# --- fill in the middle -----------------------------------------------------------

def filled_rows(rows) -> list[tuple]:
    import re
    out = []
    for i, t, *_ in rows:
        t = t or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
        p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")):
            out.append((i, len(lines), "plain", None, None, t))
        elif h4 % 100 < 50:
            out.append((i, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((i, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return out


def line_rows() -> list[tuple]:
    rng = random.Random(8)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "é\nüb\n", "a\r\nb\rc\n", "x <P> y\nz", "<\nS>\n<S", "<S\n>\n<", "<M>",
             "𝒳𝒴\n" * 5, "\n" * 70_000, "ab\n" * 60_000 + "end", "x" * 200_000 + "\ny\n", "é" * 70_000 + "\n" + "\n" * 9 + "z"]
    texts += ["".join(rng.choice("ab\né") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, "no\nid\nhere\n", "en", "a", 0), (-5, "a\nb\nc", "en", "a", 0)]


def test_fill_in_middle(spark):
    rows = line_rows()
    got = fim.fill_in_middle(frame(spark, rows, clashes=True))
    assert multiset(got.collect()) == multiset(filled_rows(rows))
    back = got.select("doc_id", fim.restore(got["output"], got["form"]).alias("text"))
    assert multiset(back.collect()) == multiset((r[0], r[1] or "") for r in rows)


def test_fill_in_middle_rates(spark):
    rows = [(i, "a\nb\nc\nd", "en", "a", 0) for i in range(4000)]
    forms = Counter(r.form for r in fim.fill_in_middle(frame(spark, rows), plain_percent=30, spm_percent=20).collect())
    assert 1000 < forms["plain"] < 1400 and 420 < forms["spm"] < 700
    assert fim.fill_in_middle(frame(spark, [])).count() == 0


def test_filled_query_digests(spark, tmp_path):
    rows = line_rows()
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(*r[:5], digest(r[5]), digest(t or "")) for r, (_, t, *_) in zip(filled_rows(rows), rows)]
    assert multiset(filled(spark, str(tmp_path)).collect()) == multiset(want)


@pytest.mark.parametrize("make", [
    lambda rng: sorted(rng.sample(range(1 << 20), 500)),  # arrays
    lambda rng: sorted(rng.sample(range(1 << 17), 90_000)),  # bitmaps
    lambda rng: [i for s in range(0, 1 << 18, 1000) for i in range(s, s + 700)],  # runs, across containers
    lambda rng: [65_535, 65_536, 1 << 30],
    lambda rng: [],
])
def test_boundary_set(make):
    offsets = make(random.Random(1))
    found = fim.BoundarySet(np.array(offsets, np.int64))
    assert len(found) == len(offsets) and found.cut(0) == 0
    for k in random.Random(2).sample(range(len(offsets)), min(len(offsets), 2000)):
        assert found.select(k) == offsets[k] and found.cut(k + 1) == offsets[k]


def test_containers_take_the_smallest_form():
    kinds = [type(fim.container(np.array(x))) for x in ([1, 5, 9], list(range(5000)), sorted(random.Random(1).sample(range(65536), 30_000)))]
    assert kinds == [fim.ArrayContainer, fim.RunContainer, fim.BitmapContainer]


# --- SimHash ----------------------------------------------------------------------

def print_of(text) -> int:
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids, prints) -> list[tuple]:
    """(id, print, least id of the component), all pairs compared."""
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[max(top(i), top(j))] = min(top(i), top(j))
    least: dict = {}
    for i, own in enumerate(ids):
        known = [x for x in (least.get(top(i)), own) if x is not None]
        least[top(i)] = min(known) if known else None
    return [(own, f"{p:016x}", least[top(i)]) for i, (own, p) in enumerate(zip(ids, prints))]


def test_hash_is_the_engines(spark):
    from pyspark.sql import functions as F
    text = "Çà et là trois, of some length over 32 bytes"
    data = np.frombuffer(text.encode(), np.uint8)
    got, _ = simhash.shingle_hashes(data, np.array([0, len(data)]))
    w = words(text.translate(LOWER))
    want = spark.createDataFrame([(" ".join(w[i:i + 4]),) for i in range(len(w) - 3)], "s string").select(F.xxhash64("s")).collect()
    assert got.view(np.int64).tolist() == [r[0] for r in want]


@pytest.mark.parametrize("options", [{}, {"group": 2}, {"blocks": 7}])
def test_simhash_groups(spark, options):
    rng = random.Random(2)
    rows = corpus()
    long = sentence(rng, 400).split()  # near copies whose fingerprints differ in a few bits
    for i in range(25):
        long[rng.randrange(len(long))] = sentence(rng, 1)
        rows.append((1000 + i, "\t ".join(long).upper() if i % 3 == 0 else " ".join(long), "en", "hot", 0))
    got = simhash.near_groups(frame(spark, rows, clashes=True), **options)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = grouped([r[0] for r in rows], [print_of(r[1]) for r in rows])
    assert multiset(got.collect()) == multiset(want)
    assert len({w[2] for w in want}) < len(rows) - 40


def test_simhash_of_nothing(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    got = simhash.near_groups(frame(spark, [(None, None, "en", "a", 0), (4, " ", "en", "a", 0), (3, "", "en", "a", 0)])).collect()
    assert multiset(got) == multiset([(None, "0" * 16, 3), (4, "0" * 16, 3), (3, "0" * 16, 3)])


@pytest.mark.parametrize("blocks,group", [(5, 4096), (6, 4096), (8, 4096), (5, 40), (6, 3)])
def test_links_connect_what_is_near(spark, blocks, group):
    """Clouds of fingerprints around a few centres, some of them dense, and chains."""
    rng = random.Random(blocks * group)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre, reach = rng.getrandbits(64), rng.sample(range(64), 14)
        prints |= {centre ^ sum(1 << b for b in rng.sample(reach, rng.randint(0, 6))) for _ in range(90)}
    for _ in range(100):
        walk = rng.getrandbits(64)
        for _ in range(5):
            prints.add(walk)
            walk ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5])))
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, group, blocks).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    place = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        a, b = top(place[a]), top(place[b])
        parent[max(a, b)] = min(a, b)
    want = grouped(list(range(len(prints))), prints)
    assert [(i, f"{p:016x}", top(i)) for i, p in enumerate(prints)] == want


def test_keys_of_close_prints_meet():
    rng = random.Random(9)
    for blocks in (5, 6, 7, 8):
        a = rng.getrandbits(64)
        for _ in range(200):
            b = a ^ sum(1 << i for i in rng.sample(range(64), 4))
            x, y = simhash.block_keys(np.array([a, b], np.uint64), blocks)
            assert set(x.tolist()) & set(y.tolist())
    assert [simhash.block_count(n) for n in (10, 10 ** 7, 10 ** 10, 10 ** 12)] == [5, 6, 7, 8]
