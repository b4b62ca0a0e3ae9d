"""Repeated passages by bucket-pointer refinement of suffixes.

A byte string of ``LENGTH`` bytes that also starts in a document with a smaller
doc_id is to be removed.  Suffixes are sorted into buckets that are refined step by
step, and a step only looks at what the step before left open:

1. Buckets of q-grams.  Only suffixes at anchors take part: a string's anchor is its
   q-gram of smallest hash, so equal strings have their anchors in equal buckets.
   A bucket that one document fills alone is closed.
2. An anchor answers for a run of neighbouring strings.  Buckets are refined by the
   bytes at later and earlier offsets up to the end of that run; each part is named
   by a pointer (a hash) that is built from the pointers of its pieces.  In a
   refined bucket all strings are equal, so the smallest doc_id settles the whole
   run at once.  A bucket that stays in one piece is closed.
3. Runs that split a bucket are refined to their single strings of LENGTH bytes: words
   of eight bytes are the first buckets, and wider ones are made from the identifiers of
   the buckets that the suffixes at later offsets are in, recursively, until all LENGTH
   bytes are told apart.  Identifiers are integers and exact within a part; parts meet
   by 96 bits that name a bucket's string, and it goes to the smallest doc_id.

Documents are dealt into parts by a hash, and the shuffled texts are used by all
steps.  A step sends a part's distinct pointers, sorted and packed, to the buckets'
tasks, and gets back bits in the same order, so what travels is a few bytes per open
suffix.  A part sends a pointer once however many of its documents hold it: a bucket
that a third of all documents share gets one row from each part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, text_bytes

LENGTH = 50
GRAM = 28
RUN = LENGTH - GRAM + 1        # strings in which one q-gram can be the anchor
# Text bytes of a part and anchors of a bucket, on average.  Both grow with the input
# between these bounds, so that parts times buckets, the rows that travel, do not
# grow with its square.
SMALL_PART, PART, LARGE_PART = 1 << 20, 64 << 20, 256 << 20
BUCKET, LARGE_BUCKET = 2_000_000, 32_000_000
BLOCK = 1 << 20                # text bytes whose hashes are held at once
_K = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Plan:
    """How texts are dealt, the same in all steps."""

    parts: int
    bucket_bits: int
    low_id: int
    id_bytes: int

    @staticmethod
    def of(docs: DataFrame) -> Plan:
        size, low, high = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
        size, low, high = size or 0, low or 0, high or 0
        part = min(max(size // 4096, PART), LARGE_PART)
        anchors = size // 12
        bucket = min(max(anchors // 4096, BUCKET), LARGE_BUCKET)
        bits = 6
        while anchors > bucket << bits and bits < 31:
            bits += 1
        return Plan(max(1, -(-size // part), min(256, -(-size // SMALL_PART))), bits, low,
                    (int(high - low + 1).bit_length() + 7) // 8)

    def pack_ids(self, ids: np.ndarray) -> bytes:
        return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.id_bytes]).tobytes()

    def unpack_ids(self, raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // self.id_bytes, 8), np.uint8)
        out[:, :self.id_bytes] = np.frombuffer(raw, np.uint8).reshape(-1, self.id_bytes)
        return out.view("<u8").reshape(-1).astype(np.int64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


class Part:
    """The texts of one part with their anchors and the runs they answer for."""

    def __init__(self, table: pa.Table, plan: Plan) -> None:
        self.plan = plan
        ids = table.column("doc_id").combine_chunks().cast(pa.int64())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        # null ids come after all others; numbers from 0 on
        beyond = (1 << (8 * plan.id_bytes)) - 1
        self.ids = np.where(known, ids.fill_null(0).to_numpy() - plan.low_id, beyond) if len(ids) else np.zeros(0, np.int64)
        data, self.offsets = text_bytes(table.column("text"))
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = _words(self.data)
        places, firsts, lasts = [], [], []
        at, n = 0, len(self.ids)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + BLOCK)))
            stop = min(stop, n)
            for kept, found in zip((places, firsts, lasts), self._anchors(at, stop)):
                kept.append(found)
            at = stop
        self.place, self.first, self.last = (np.concatenate(x) if x else np.zeros(0, np.int64)
                                             for x in (places, firsts, lasts))
        self.owner = self.ids[np.searchsorted(self.offsets, self.place, side="right") - 1] if n else self.place
        self.gram = self._pointers(self.place, np.full(len(self.place), GRAM), GRAM) >> np.uint64(32 - plan.bucket_bits)

    def _anchors(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of texts lo to hi - 1, and the first and last string of each one's run."""
        begin, end = int(self.offsets[lo]), int(self.offsets[hi])
        if end - begin < LENGTH:
            return (np.zeros(0, np.int64),) * 3
        x = self.words[begin:end] * _K
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD1342543DE82EF95)
        # the smallest hash and, of equals, the leftmost
        x &= ~np.uint64((1 << 32) - 1)
        x |= np.arange(len(x), dtype=np.uint64)
        least = _smallest(x, RUN)[:end - begin - LENGTH + 1]
        stops = np.repeat(self.offsets[lo + 1:hi + 1] - begin, np.diff(self.offsets[lo:hi + 1]))
        start = np.flatnonzero(stops[:len(least)] - np.arange(len(least)) >= LENGTH)
        place = (least[start] & np.uint64((1 << 32) - 1)).astype(np.int64)
        if not len(place):
            return (np.zeros(0, np.int64),) * 3
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        return place[new] + begin, start[new] + begin, start[np.r_[new[1:], len(place)] - 1] + begin

    def _buckets(self, at: np.ndarray, width: int) -> np.ndarray:
        """The bucket identifier (an integer from 0 on) of the ``width`` bytes at each place;
        equal bytes, and they alone, have equal identifiers.

        A bucket of a third of the width or more is refined by the identifiers of the
        buckets that the suffixes at later offsets are in.  These are the same
        identifiers, found once for all places that are read, and made the same way from
        narrower buckets, down to words of eight bytes.
        """
        if width == 8:
            return pd.factorize(self.words[at])[0]
        part = 8
        while 3 * part < width:
            part *= 3
        later = [*range(0, width - part, part), width - part]
        read = np.zeros(len(self.words), bool)
        for offset in later:
            read[at + offset] = True
        places = np.flatnonzero(read)
        found = self._buckets(places, part)
        where = np.zeros(len(self.words), np.int32)
        where[places] = found
        distinct = int(found.max()) + 1 if len(found) else 1
        out, held = where[at].astype(np.int64), distinct
        for offset in later[1:]:
            if held * distinct >= 1 << 63:  # too many for one number: name the pairs so far
                out, names = pd.factorize(out)
                held = len(names)
            out = out * distinct + where[at + offset]
            held *= distinct
        return pd.factorize(out)[0]

    def _tails(self, start: np.ndarray) -> np.ndarray:
        """32 more bits for the strings of LENGTH bytes, made apart from ``_pointers``."""
        out = np.zeros(len(start), np.uint64)
        for i in range(0, LENGTH, 8):
            out = (out ^ self.words[start + min(i, LENGTH - 8)]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(32)
        return out >> np.uint64(32)

    def _pointers(self, start: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
        """A 64-bit pointer of ``size`` bytes (eight at least) from each start on."""
        out = mix64(size.astype(np.uint64) + np.uint64(LENGTH))
        final = start + size - 8
        for i in range(0, longest, 8):
            out = mix64(out * _K + self.words[np.minimum(start + i, final)])
        return out

    # step 1
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct q-gram pointers, sorted, and which of them several documents hold."""
        order = np.argsort(self.gram, kind="stable")
        sorted_, owner = self.gram[order], self.owner[order]
        if not len(sorted_):
            return sorted_, np.zeros(0, bool)
        cut = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        return sorted_[cut], np.minimum.reduceat(owner, cut) != np.maximum.reduceat(owner, cut)

    def _open(self, answers: Answers) -> np.ndarray:
        """Anchors in buckets that several documents fill."""
        distinct, _ = self.grams()
        shared = answers.flags(1, distinct >> np.uint64(32))
        if not len(distinct):
            return np.zeros(0, np.int64)
        return np.flatnonzero(shared[np.searchsorted(distinct, self.gram)])

    # step 2
    def runs(self, answers: Answers) -> Runs:
        at = self._open(answers)
        size = self.last[at] - self.first[at] + LENGTH
        context = mix64(self._pointers(self.first[at], size, LENGTH + RUN - 1)
                        + (self.place[at] - self.first[at]).astype(np.uint64) * _K)
        gram, owner = self.gram[at], self.owner[at]
        order = np.lexsort((owner, context, gram))
        at, gram, context, owner = at[order], gram[order], context[order], owner[order]
        if not len(at):
            return Runs(at, *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool), gram, context, owner)
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, context[1:] != context[:-1]]
        cut = np.flatnonzero(new)
        group = np.cumsum(new) - 1                      # refined bucket of each anchor
        in_gram = np.cumsum(new_gram)[cut] - 1
        nth = np.arange(len(cut)) - np.flatnonzero(np.r_[True, in_gram[1:] != in_gram[:-1]])[in_gram]
        # two refined buckets of a bucket are enough to show that it is split
        return Runs(at, group, owner[cut], nth < 2, gram[cut], context[cut], owner)

    # step 3
    def strings(self, answers: Answers) -> tuple[Strings, np.ndarray, np.ndarray]:
        """Strings still open; and runs (first, last) that step 2 has settled."""
        runs = self.runs(answers)
        sent = np.flatnonzero(runs.sent)
        taken, split = np.zeros(len(runs.low), bool), ~runs.sent
        bits = answers.flags(2, np.repeat(runs.gram[sent] >> np.uint64(32), 2))
        taken[sent], split[sent] = bits[0::2], bits[1::2]
        # a document that is not the smallest holder in this part is settled here
        settled = taken[runs.group] | (runs.owner > runs.low[runs.group])
        left = runs.at[~settled & split[runs.group]]
        size = self.last[left] - self.first[left] + 1
        start = np.repeat(self.first[left], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        owner = np.repeat(self.owner[left], size)
        bucket = self._buckets(start, LENGTH)  # exact: equal strings of this part, and no others
        held = int(bucket.max()) + 1 if len(bucket) else 0
        low, some = np.full(held, np.iinfo(np.int64).max), np.zeros(held, np.int64)
        np.minimum.at(low, bucket, owner)
        some[bucket] = start
        name = self._pointers(some, np.full(held, LENGTH), LENGTH)
        tail = self._tails(some)
        order = np.argsort(name, kind="stable")
        place = np.empty(held, np.int64)
        place[order] = np.arange(held)
        strings = Strings(start, place[bucket], name[order], tail[order], low[order], owner)
        done = runs.at[settled]
        return strings, self.first[done], self.last[done]

    def removed(self, answers: Answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document number, start and end (in its text) of each removed run of bytes."""
        strings, first, last = self.strings(answers)
        taken = answers.flags(3, strings.name >> np.uint64(64 - self.plan.bucket_bits))
        gone = strings.start[taken[strings.group] | (strings.owner > strings.low[strings.group])] if len(strings.start) \
            else strings.start
        start, end = np.concatenate([first, gone]), np.concatenate([last, gone]) + LENGTH
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
        doc = np.searchsorted(self.offsets, start, side="right") - 1
        new = np.flatnonzero(np.r_[True, (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])]) if len(start) else start
        doc, start = doc[new], start[new]
        end = end[np.r_[new[1:], len(end)] - 1] if len(new) else end
        return doc, start - self.offsets[doc], end - self.offsets[doc]


@dataclass(frozen=True)
class Runs:
    """Open anchors ``at`` sorted by refined bucket, and per refined bucket the
    smallest document, whether it is sent, and its pointers; ``owner`` per anchor."""

    at: np.ndarray
    group: np.ndarray
    low: np.ndarray
    sent: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    owner: np.ndarray


@dataclass(frozen=True)
class Strings:
    """Open strings with their bucket (``group``) and document (``owner``); and per bucket,
    sorted by name, 96 bits that name its string and the smallest document."""

    start: np.ndarray
    group: np.ndarray
    name: np.ndarray
    tail: np.ndarray
    low: np.ndarray
    owner: np.ndarray


class Answers:
    """Bits that came back for a part, by step and bucket."""

    def __init__(self, table: pa.Table) -> None:
        self.bits = {(s, b): x for s, b, x in zip(*(table.column(c).to_pylist() for c in ("step", "bucket", "bits")))}

    def flags(self, step: int, bucket: np.ndarray) -> np.ndarray:
        """One flag for each entry, whose buckets are given in rising order."""
        out = np.zeros(len(bucket), bool)
        if not len(bucket):
            return out
        cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            raw = self.bits.get((step, int(bucket[lo])))
            if raw is not None:
                out[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=hi - lo).astype(bool)
        return out


_ASK = "bucket int, part int, pointers binary, more binary, ids binary"
_ANSWER = "part int, step int, bucket int, bits binary"


def _asked(part: int, bucket: np.ndarray, pack) -> pa.Table:
    """One row per bucket; ``pack(lo, hi)`` gives the entries' three binary columns."""
    cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, int)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    packed = [pack(lo, hi) for lo, hi in spans]
    return pa.table({"bucket": pa.array([int(bucket[lo]) for lo, _ in spans], pa.int32()),
                     "part": pa.array([part] * len(spans), pa.int32()),
                     **{c: pa.array([p[i] for p in packed], pa.binary()) for i, c in enumerate(("pointers", "more", "ids"))}})


def _answered(table: pa.Table, step: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    """Flags of all entries of a bucket, cut back into the rows they came in; rows
    without a set flag need no answer."""
    rows = []
    at = 0
    for part, bucket, n in zip(table.column("part").to_pylist(), table.column("bucket").to_pylist(), sizes):
        own = flags[at:at + n]
        at += n
        if own.any():
            rows.append((part, step, bucket, np.packbits(own).tobytes()))
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(
        (("part", pa.int32()), ("step", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())))})


def _number(table: pa.Table) -> int:
    return table.column("part")[0].as_py()


def _low32(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def _unpacked(table: pa.Table, column: str, kind: str) -> tuple[np.ndarray, list[int]]:
    arrays = [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]
    return np.concatenate(arrays), [len(a) for a in arrays]


def _steps(plan: Plan):
    """The functions of the three steps: ask from a part, answer in a bucket; and the end."""
    def ask_grams(table: pa.Table) -> pa.Table:
        grams, several = Part(table, plan).grams()
        return _asked(_number(table) if len(table) else 0, grams >> np.uint64(32),
                      lambda lo, hi: (_low32(grams[lo:hi]), np.packbits(several[lo:hi]).tobytes(), b""))

    def answer_grams(table: pa.Table) -> pa.Table:
        pointers, sizes = _unpacked(table, "pointers", "<u4")
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n)
                                  for x, n in zip(table.column("more").to_pylist(), sizes)])
        _, which, times = np.unique(pointers, return_inverse=True, return_counts=True)
        shared = times > 1
        shared[which[several == 1]] = True
        return _answered(table, 1, shared[which], sizes)

    def ask_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _asked(0, np.zeros(0, np.uint64), None)
        runs = Part(left, plan).runs(Answers(right))
        gram, context, low = runs.gram[runs.sent], runs.context[runs.sent], runs.low[runs.sent]
        return _asked(_number(left), gram >> np.uint64(32), lambda lo, hi: (
            _low32(gram[lo:hi]), context[lo:hi].astype("<u8").tobytes(), plan.pack_ids(low[lo:hi])))

    def answer_runs(table: pa.Table) -> pa.Table:
        gram, sizes = _unpacked(table, "pointers", "<u4")
        context, _ = _unpacked(table, "more", "<u8")
        low = np.concatenate([plan.unpack_ids(x) for x in table.column("ids").to_pylist()])
        order = np.lexsort((low, context, gram))
        g, c, d = gram[order], context[order], low[order]
        new_gram = np.r_[True, g[1:] != g[:-1]]
        new = new_gram | np.r_[True, c[1:] != c[:-1]]
        taken = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        pieces = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram))
        split = pieces[np.cumsum(new_gram) - 1] > 1
        both = np.zeros((len(g), 2), bool)
        both[order, 0], both[order, 1] = taken, split
        return _answered(table, 2, both.reshape(-1), [2 * n for n in sizes])

    def ask_strings(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _asked(0, np.zeros(0, np.uint64), None)
        strings, _, _ = Part(left, plan).strings(Answers(right))
        return _asked(_number(left), strings.name >> np.uint64(64 - plan.bucket_bits), lambda lo, hi: (
            strings.name[lo:hi].astype("<u8").tobytes(), _low32(strings.tail[lo:hi]), plan.pack_ids(strings.low[lo:hi])))

    def answer_strings(table: pa.Table) -> pa.Table:
        name, sizes = _unpacked(table, "pointers", "<u8")
        tail, _ = _unpacked(table, "more", "<u4")
        low = np.concatenate([plan.unpack_ids(x) for x in table.column("ids").to_pylist()])
        order = np.lexsort((low, tail, name))
        n, t, d = name[order], tail[order], low[order]
        new = np.r_[True, (n[1:] != n[:-1]) | (t[1:] != t[:-1])]
        taken = np.zeros(len(name), bool)
        taken[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        return _answered(table, 3, taken, sizes)

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left, plan)
        doc, start, stop = part.removed(Answers(right))
        bounds = np.searchsorted(doc, np.arange(len(part.ids) + 1))
        digests = []
        for i, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            raw = part.data[part.offsets[i]:part.offsets[i + 1]]
            digest, at = hashlib.sha256(), 0
            for s, e in zip(start[lo:hi].tolist(), stop[lo:hi].tolist()):
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            digests.append(digest.hexdigest())
        runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["s", "e"]))
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(np.diff(part.offsets), pa.int64()),
                         "removed": runs, "kept_sha256": pa.array(digests, pa.string())})

    return ask_grams, answer_grams, ask_runs, answer_runs, ask_strings, answer_strings, end


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (runs of bytes from s up
    to e, in order, apart from each other) and kept_sha256 of the remaining bytes.

    Texts are UTF-8 bytes; null counts as empty.  Texts shorter than LENGTH lose
    nothing.  Rows that repeat a doc_id count as one document and take nothing from
    each other; null ids come after all others and count as one document.  An empty
    table gives an empty result; other columns are ignored.
    """
    plan = Plan.of(docs)
    ask_grams, answer_grams, ask_runs, answer_runs, ask_strings, answer_strings, end = _steps(plan)
    # one shuffle of the texts serves all four uses below
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.parts)).cast("int")
    parts = docs.select(part.alias("part"), "doc_id", "text").groupBy("part")
    asked = parts.applyInArrow(ask_grams, _ASK)
    answers = asked.groupBy("bucket").applyInArrow(answer_grams, _ANSWER)
    asked = parts.cogroup(answers.groupBy("part")).applyInArrow(ask_runs, _ASK)
    answers = answers.union(asked.groupBy("bucket").applyInArrow(answer_runs, _ANSWER))
    asked = parts.cogroup(answers.groupBy("part")).applyInArrow(ask_strings, _ASK)
    answers = answers.union(asked.groupBy("bucket").applyInArrow(answer_strings, _ANSWER))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return parts.cogroup(answers.groupBy("part")).applyInArrow(
        end, f"doc_id {id_type}, n_bytes long, removed array<struct<s:long,e:long>>, kept_sha256 string")
