"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names the literal tokens (runs of letters and digits of any script) that
any URL it fits must hold.  The token that is rarest among the URLs at hand becomes the
rule's index entry.  The tokens of a URL fetch candidate rules by a join, and only
those run their regular expression; a URL without candidate passes straight through.
Rules without a sure token (a host or path that may go on) cannot be indexed: they
run on every URL.  Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stage


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over lower-cased host + path; ``tokens`` are literals in
    each of its matches.  ``rank`` orders rules that fit the same URL, the
    largest wins.  ``shown`` is the text reported for the rule, if any."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int
    shown: str | None = None


def _literals(text: str) -> list[str]:
    """The tokens of a rule's text as ``_tokens`` cuts a URL: A-Z lower-cased, letters
    and digits of any script."""
    return re.findall(r"[^\W_]+", text.translate(_TO_LOWER))


_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule ``host/path``: its host and all subdomains, paths that start with ``/path``."""
    host, _, path = rule.partition("/")
    pattern = rf"^([^/]*\.)?{re.escape(host + '/' + path)}"
    # the last token of a path may go on in the URL, so it is no whole token
    sure = _literals(host) + _literals(path)[:None if path and not path[-1].isalnum() else -1]
    return Rule(rule, pattern, tuple(sure), verdict, 1000 + len(rule), rule)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule for a whole token (or tokens joined by hyphens) anywhere in the host."""
    edge = r"\p{L}\p{N}"
    return Rule(word, rf"^([^/]*[^{edge}/])?{re.escape(word)}([^{edge}]|$)", tuple(_literals(word)), verdict, len(word))


# The rules of the query's contract, then the words of the method's own rules.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
              ("allow", "com/fr/"), ("block", "com/de/"))
BLOCKED_WORDS = ("casino", "casino-win", "spam", "spam-farm", "ads-track", "ads", "porn", "xxx", "malware", "phishing",
                 "warez", "torrent")


def default_rules() -> list[Rule]:
    return [host_rule(v, r) for v, r in HOST_RULES] + [word_rule(w) for w in BLOCKED_WORDS]


def _lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return _lower(F.coalesce(host, F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_lower(target), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def rule_index(spark: SparkSession, urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule that names a token, with ``token``, the rarest of its literals
    among the tokens of ``urls`` (column target); equals go by code point."""
    table = spark.createDataFrame(
        [(i, r.name, r.pattern, r.verdict, r.rank, r.shown, list(r.tokens)) for i, r in enumerate(rules) if r.tokens],
        "rule_id int, name string, pattern string, rule_verdict string, rank int, shown string, tokens array<string>")
    entries = table.select("rule_id", F.explode("tokens").alias("token"))
    counts = (urls.select(F.explode(_among(sorted({t for r in rules for t in r.tokens}))).alias("token"))
              .groupBy("token").count())
    best = (entries.join(counts, "token", "left")
            .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("best")))
    return table.join(best, "rule_id").select("rule_id", "name", "pattern", "rule_verdict", "rank", "shown",
                                              F.col("best.token").alias("token"))


def _among(wanted: list[str]) -> Column:
    """The tokens of ``target`` that are in a set of literals (looked up by hash)."""
    return F.filter(_tokens(F.col("target")), lambda t: t.isin(wanted) if wanted else F.lit(False))


_WON = "struct<rank:int,name:string,shown:string,rule_verdict:string>"


def _best_of(rules: list[Rule]) -> Column:
    """The winner among rules that run on every URL; null where none fits."""
    fits = [F.when(F.col("target").rlike(r.pattern), F.struct(
        F.lit(r.rank).cast("int").alias("rank"), F.lit(r.name).alias("name"), F.lit(r.shown).cast("string").alias("shown"),
        F.lit(r.verdict).alias("rule_verdict"))).cast(_WON) for r in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast(_WON)


def judge(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, matched.

    ``rule`` is the winning rule's text when it is one to report, ``matched`` the
    winning rule's name, whichever it is.  A null url, or one without ``://``, has
    an empty host and path; unless a rule fits the empty text it gets ``default``.
    Path rules compare upper and lower case as they stand.  A rule without a sure token
    is tried on every URL.  Urls of any length are read whole.  Repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    rules = default_rules() if rules is None else rules
    url = F.col("url")
    base = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(url).alias("host"),
                        path_of(url).alias("path")).withColumn("target", F.concat("host", "path"))
    base = stage(base, "url_targets")
    index = stage(rule_index(spark, base, rules), "url_index")  # one row a rule
    wanted = sorted(r["token"] for r in index.select("token").distinct().collect())  # no more than the given rules
    named = base.withColumn("tokens", _among(wanted)).withColumn("always", _best_of([r for r in rules if not r.tokens]))
    own = ["page_id", "host", "path"]
    straight = named.filter(F.size("tokens") == 0).select(*own, F.col("always").alias("won"))
    seen = named.filter(F.size("tokens") > 0).withColumn("token", F.explode("tokens")).join(index, "token")
    fits = F.expr("target rlike pattern")
    hit = F.max(F.when(fits, F.struct("rank", "name", "shown", "rule_verdict"))).cast(_WON)
    judged = seen.groupBy("row", *own, "always").agg(hit.alias("hit")).select(*own, F.greatest("always", "hit").alias("won"))
    return straight.unionByName(judged).select(
        *own, F.col("won.shown").alias("rule"), F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict"),
        F.col("won.name").alias("matched"))
