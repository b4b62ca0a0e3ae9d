"""Small corpora with the awkward cases, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators use inside
CLASHES = ("size", "score", "key", "part", "root", "v", "finish", "copy", "copies", "turn", "shard", "slot", "target",
           "set_id", "digest", "maybe", "mix_size", "mix_key", "label", "label_id", "token", "row", "virtual_slot")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed: int = 5) -> list[tuple]:
    """Rows of SCHEMA: copies, near copies, shared passages, null and empty texts,
    white space only, a very long text, repeated rows, null ids and sources."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    passage = sentence(rng, 30)

    def add(text, doc_id=..., source="b"):
        rows.append((len(rows) if doc_id is ... else doc_id, text, "en", source, 0 if text is None else len(text)))

    for i in range(12):
        add(sentence(rng, rng.randint(1, 80)), source=rng.choice(["a", "b", None]))
    for i in range(10):
        base = sentence(rng, 60).split()
        add(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = sentence(rng, 1)
            add(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy), source="hot")
    for _ in range(6):
        add(f"{sentence(rng, 20)} {passage} {sentence(rng, 10)}", source="c")
    same = sentence(rng, 25)
    for _ in range(9):
        add(same, source="hot")
    for text in (None, None, "", "", " \t\n", "one", "One", "two words", "é" * 60, "é" * 60 + "x", "a" * 200, "a" * 120):
        add(text)
    add(sentence(rng, 30_000), source="long")
    rows.append(rows[3])
    rows.append(rows[3])
    add(same, doc_id=None, source=None)
    add(sentence(rng, 40), doc_id=None)
    return rows


def frame(spark, rows, clashes: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return df


def words(text) -> list[str]:
    return WORDS.findall(text or "")


def shingles(text) -> frozenset:
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_components(rows) -> list[tuple]:
    """(doc_id, n_shingles, component_id) per row, all pairs compared."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least: dict[int, int | None] = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(top(i)), r[0]) if x is not None]
        least[top(i)] = min(ids) if ids else None
    return [(r[0], len(s), least[top(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def removed_bytes(rows, length: int = 50) -> list[tuple]:
    """(doc_id, bytes, removed, runs, digest) per row."""
    texts = [(float("inf") if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first: dict[bytes, float] = {}
    for i, t in texts:
        for s in range(len(t) - length + 1):
            k = t[s:s + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, t), row in zip(texts, rows):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s:s + length]] < i:
                gone[s:s + length] = b"\x01" * length
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((row[0], len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def benchmark_hits(rows, items, width: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, items) per row."""
    windows = defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i:i + width])].add("" if item is None else str(item))
    out = []
    for r in rows:
        w = BENCH_WORD.findall((r[1] or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                k = tuple(w[i:i + n])
                if k in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((r[0], len(w), len(hit), tuple(sorted(found))))
    return out


def multiset(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
