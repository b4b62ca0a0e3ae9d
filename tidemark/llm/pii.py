"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and finds the anchors: at-signs,
plus-signs, digits, schemes and identifier cues.  At each anchor a local parser
expands to the left or right and validates what it has found.  No pattern is
searched for over the whole text, and every parser moves forward only, so time
is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_blocks

KINDS = ("email", "ip", "card", "phone")            # their order where spans start together
ADDED = ("account", "credential", "secret")         # what the method adds
# Cues in lower case; each is also sought in upper case and capitalised.  No
# cue is part of another.
SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key")
ACCOUNT_CUES = ("iban",)
BLOCK = 4 << 20  # bytes of text looked at together

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIAL = re.compile(r"[0-9][ ().0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_USERINFO = re.compile(r"[^\x09-\x0D\x20/?#@:]+:[^\x09-\x0D\x20/?#@]+@")
# After a cue blanks, a sign and perhaps a quote: four characters or more after an equals
# sign or in quotes; bare after a colon, where prose may follow, a value with a digit.
SECRET_SIGN = r"[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
_V, _BARE = r"[^\x09-\x0D\x20\"'&;,]", r"[^\x09-\x0D\x20\"'&;,0-9]"
SECRET_VALUE = (rf"[ \t]{{0,3}}(?:=[ \t]{{0,3}}[\"']?{_V}{{4,}}|:[ \t]{{0,3}}(?:[\"']{_V}{{4,}}|[0-9]{_V}{{3,}}|{_BARE}[0-9]{_V}{{2,}}"
                rf"|{_BARE}{{2}}[0-9]{_V}+|{_BARE}{{3,}}[0-9]{_V}*))")
_SIGN = re.compile(SECRET_SIGN)
_VALUE = re.compile(SECRET_VALUE)

_AFTER = {"scheme": _USERINFO, "secret": _VALUE, "account": _IBAN}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for ch in "0123456789":
        out.add_word(ch, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    out.add_word("://", ("scheme", 3))
    for name, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                out.add_word(form, (name, len(form)))
    out.make_automaton()
    return out


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """(kind, start, end) in code points, ordered by start, then kind.  Spans of one
    kind do not overlap: a cue inside a value found before is part of that value."""
    found: list[Span] = []
    email_end = dotted_end = chain_end = 0
    ends = dict.fromkeys(("scheme", "secret", "account"), 0)
    for at, (anchor, width) in anchors.iter(text):
        if anchor == "digit":
            if at >= dotted_end:
                dotted_end = _dotted(text, at, found)
            if at >= chain_end:
                chain_end = _chain(text, at, found)
        elif anchor == "at":
            email_end = _email(text, at, email_end, found)
        elif anchor == "plus":
            _phone(text, at, found)
        elif at + 1 - width < ends[anchor]:
            continue
        elif m := _AFTER[anchor].match(text, at + 1):
            ends[anchor] = m.end()
            if anchor == "scheme":
                found.append(("credential", at + 1, m.end() - 1))
            elif anchor == "secret":
                found.append(("secret", _SIGN.match(text, at + 1).end(), m.end()))
            else:
                _account(m, found)
    order = {k: i for i, k in enumerate(KINDS + ADDED)}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def _email(text: str, at: int, floor: int, found: list[Span]) -> int:
    """Expand an at-sign; the local part starts no earlier than the last match ended."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (m := _DOMAIN.match(text, at + 1)):
        return floor
    found.append(("email", start, m.end()))
    return m.end()


def _dotted(text: str, at: int, found: list[Span]) -> int:
    """Numbers joined by single dots: every four of them, from the first on, make a candidate."""
    m = _DOTTED.match(text, at)
    parts = list(_DIGITS.finditer(text, at, m.end()))
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        if all(len(n := p.group().lstrip("0")) <= 3 and int(n or 0) <= 255 for p in four):
            found.append(("ip", four[0].start(), four[3].end()))
    return m.end()


def _chain(text: str, at: int, found: list[Span]) -> int:
    """Digits with at most one space or hyphen between them."""
    m = _CHAIN.match(text, at)
    if m.end() - at >= 12:
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", at, m.end()))
    return m.end()


def _phone(text: str, at: int, found: list[Span]) -> None:
    m = _DIAL.match(text, at + 1)
    if not m:
        return
    end = at + 1 + len(m.group().rstrip(" ().-"))  # the number ends with a digit
    if end - at >= 4 and 9 <= sum(c.isdigit() for c in text[at:end]) <= 15:
        found.append(("phone", at, end))


def _account(m: re.Match, found: list[Span]) -> None:
    """The longest valid IBAN after its cue."""
    raw, start = m.group(1), m.start(1)
    for end in range(len(raw), 14, -1):
        code = raw[:end].replace(" ", "")
        if raw[end - 1] != " " and 15 <= len(code) <= 34 and iban_valid(code):
            found.append(("account", start, start + end))
            return


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end).

    Offsets are code points, ends exclusive.  A secret is what follows its cue after
    blanks, ``=`` or ``:`` and a quote; the quote is no part of it.  Null text counts as
    empty and has no spans.  Texts of any length are read whole, block by block.
    Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for block in byte_blocks(batches, "text", BLOCK):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, anchors)] if t else []
                     for t in (x.as_py() for x in block.column("text"))]
            out = pa.Table.from_arrays([block.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])
            yield from out.combine_chunks().to_batches()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long>>")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per base kind, the base spans' SHA-256 and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
