"""The registered queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (decontaminate, exact_dedup, fim, mixing, near_dup, pii, quality, sharding, simhash, spelling,
                          suffix_dedup, token_counts, url_filter)
from tidemark.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                   read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))


@register("op2_token_counts")
def tokens(spark: SparkSession, sf_dir: str, vocabulary: str = token_counts.VOCABULARY) -> DataFrame:
    """``vocabulary``: a SentencePiece model file that the driver can read."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), token_counts.load_model(vocabulary))


@register("op3_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
""")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op4_sharding")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: virtual slots are dealt so that the shards' sizes are near equal."""
    rows = sharding.shard_positions(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@register("op5_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)]::DOUBLE AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
p AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_w,
             coalesce(sum(lim) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lim_b,
             coalesce(sum(weight) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_b
      FROM r),
f AS (SELECT *, ratio * (all_w - w_b) <= budget - lim_b AS is_full FROM p),
t AS (SELECT source, source_size, budget, CASE WHEN is_full THEN lim ELSE
        weight * (budget - sum(CASE WHEN is_full THEN lim ELSE 0.0::DOUBLE END) OVER ())
               / sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target FROM f),
c AS (SELECT d.*, source_size, target, budget,
             CASE WHEN target > 0 THEN CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                  ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target ELSE 0.0 END AS finish,
             CASE WHEN target > 0 THEN CAST(source_size AS DOUBLE) / target ELSE 0.0 END AS turn
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT finish AS v, size, budget FROM c UNION ALL SELECT finish + turn, size, budget FROM c),
q AS (SELECT max(v) AS cut FROM (SELECT v, sum(size) OVER (ORDER BY v) AS upto, budget FROM e) WHERE upto <= budget)
SELECT doc_id, source, size, source_size, target, finish,
       (CASE WHEN finish <= cut THEN 1 ELSE 0 END) + (CASE WHEN finish + turn <= cut THEN 1 ELSE 0 END) AS copies,
       size * ((CASE WHEN finish <= cut THEN 1 ELSE 0 END) + (CASE WHEN finish + turn <= cut THEN 1 ELSE 0 END)) AS taken
FROM c, q
""")
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op6_near_dup", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                       WHERE 100 * common >= 75 * (x.size + y.size - common)),
reach AS (SELECT DISTINCT a AS doc_id, a AS spot FROM links
          UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.spot = links.a),
c AS (SELECT doc_id, min(spot) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
""")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).drop("text_hash")


_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op7_decontaminate", rf"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_BENCH_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 13) AS width, array_to_string(ws[i:i + 12], ' ') AS words
        FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0) x),
g AS (SELECT doc_id, i, width, array_to_string(ws[i:i + width - 1], ' ') AS words
      FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i
            FROM d, (SELECT DISTINCT width FROM win) l WHERE len(ws) >= width) x),
hit AS (SELECT doc_id, i, g.width, item FROM g JOIN win ON g.words = win.words AND g.width = win.width),
n AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS spot FROM hit) x GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM hit) x GROUP BY 1),
tf AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM d) x GROUP BY 1),
w AS (SELECT row_number() OVER () AS id, words, string_split(words, ' ') AS win, list(item) AS items FROM win GROUP BY words),
rare AS (SELECT id, arg_min({{'word': x.word, 'i': i}}, coalesce(n, 0)) AS r
         FROM (SELECT id, unnest(win) AS word, unnest(range(0, len(win))) AS i FROM w) x LEFT JOIN tf ON x.word = tf.word GROUP BY id),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM d),
starts AS (SELECT DISTINCT pos.doc_id, rare.id, p - r.i + s AS spot FROM rare JOIN pos ON pos.word = r.word,
           (SELECT unnest(range(-{decontaminate.SLOP}, {decontaminate.SLOP} + 1)) AS s) o),
nearby AS (SELECT DISTINCT starts.doc_id, unnest(w.items) AS item FROM starts JOIN w ON starts.id = w.id JOIN d ON starts.doc_id = d.doc_id
           WHERE len(list_filter(range(0, len(win)), lambda i: NOT (spot + i + {decontaminate.SLOP} >= 0 AND list_contains(
                 ws[CAST(greatest(spot + i - {decontaminate.SLOP}, 0) + 1 AS BIGINT):CAST(greatest(spot + i + {decontaminate.SLOP} + 1, 1) AS BIGINT)],
                 win[CAST(i + 1 AS BIGINT)])))) = 0),
nb AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM nearby GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN nb ON d.doc_id = nb.doc_id
""")
def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``: items with a window whose words all stand within SLOP words of their places."""
    found = decontaminate.find(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                               read_table(spark, sf_dir, "benchmark", ["item_id", "text"]), decontaminate.SLOP)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
                        F.size("near_items").cast("long").alias("n_near"))


def _pii_sql() -> str:
    """Spans by regular expressions: places come from the lengths of the text between
    matches."""
    def cues(words: tuple[str, ...]) -> str:
        return "|".join(form for w in words for form in (w, w.upper(), w.capitalize()))

    iban = r"(?:" + cues(pii.ACCOUNT_CUES) + r")[ :#]{0,3}[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "account": iban,
        "credential": r"://[^\x09-\x0D\x20/?#@:]+:[^\x09-\x0D\x20/?#@]+@",
        "secret": "(?:" + cues(pii.SECRET_CUES) + ")" + pii.SECRET_VALUE.replace("'", "''"),
    }
    found = " UNION ALL ".join(
        f"SELECT doc_id, n, '{kind}' AS kind, {i} AS rank, regexp_extract_all(t, '{p}') AS ms, "
        f"regexp_split_to_array(t, '{p}') AS gaps FROM d" for i, (kind, p) in enumerate(patterns.items()))
    code = r"regexp_replace(m, '^(?:" + cues(pii.ACCOUNT_CUES) + r")[ :#]{0,3}', '')"
    secret = "regexp_extract(m, '^(?:" + cues(pii.SECRET_CUES) + ")" + pii.SECRET_SIGN.replace("'", "''") + "')"
    value = "CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END"
    remainder = (f"list_reduce(list_prepend(0, list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''), "
                 f"lambda c: {value})), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)")
    valid = remainder.replace("substr(x,", "substr(replace(substr(code, 1, e), ' ', ''),")
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
r AS ({found}),
u AS (SELECT doc_id, n, kind, rank, ms[i] AS m,
             CAST(list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: len(g))), 0) AS BIGINT) AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM r) x),
x AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits, {code} AS code, {secret} AS cue FROM u),
y AS (SELECT *, list_max(list_filter(CASE WHEN kind = 'account' THEN range(15, len(code) + 1) ELSE [] END, lambda e:
             substr(code, e, 1) <> ' ' AND len(replace(substr(code, 1, e), ' ', '')) BETWEEN 15 AND 34 AND {valid} = 1)) AS e FROM x),
z AS (SELECT doc_id, n, kind, rank,
             CASE kind WHEN 'account' THEN s + len(m) - len(code) WHEN 'credential' THEN s + 3 WHEN 'secret' THEN s + len(cue) ELSE s END AS s,
             CASE kind WHEN 'account' THEN s + len(m) - len(code) + e WHEN 'credential' THEN s + len(m) - 1 ELSE s + len(m) END AS e
      FROM y WHERE CASE kind
        WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda q: coalesce(TRY_CAST(q AS HUGEINT), 999) > 255)) = 0
        WHEN 'card' THEN len(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, len(digits)), lambda j:
             CASE WHEN j % 2 = 0 THEN CAST(substr(reverse(digits), j + 1, 1) AS INTEGER)
                  ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse(digits), j + 1, 1) AS INTEGER) + 1] END)) % 10 = 0
        WHEN 'phone' THEN len(digits) BETWEEN 9 AND 15 WHEN 'account' THEN e IS NOT NULL ELSE TRUE END),
g AS (SELECT n, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
             count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 4) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM z GROUP BY n)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.n = g.n
"""


@register("op8_pii", _pii_sql())
def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.personal_data(read_table(spark, sf_dir, "documents", ["doc_id", "text"])))


def _url_sql() -> str:
    rules = ", ".join(f"('{r.name}', '{r.pattern}', '{r.verdict}', {r.rank}, {'NULL' if r.shown is None else repr(r.shown)})"
                      for r in url_filter.default_rules())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id,
         {lower.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(name, pattern, verdict, rank, shown) AS (VALUES {rules}),
m AS (SELECT n, max({{'rank': rank, 'name': name, 'shown': shown, 'verdict': r.verdict}}) AS won
      FROM u JOIN rules r ON regexp_matches(host || path, pattern) GROUP BY n)
SELECT page_id, host, path, won.shown AS rule, coalesce(won.verdict, 'allow') AS verdict, won.name AS matched
FROM u LEFT JOIN m USING (n)
"""


@register("op9_url_filter", _url_sql())
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages", ["page_id", "url"]))


@register("op10_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS piece
      FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d) x),
f AS (SELECT piece, min(doc_id) AS least FROM k GROUP BY 1),
c AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS starts
      FROM k JOIN f USING (piece) WHERE least < doc_id),
r AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e
      FROM (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c) x GROUP BY doc_id, run),
kept AS (SELECT r.doc_id, s, e, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY s), 0) + 1,
                                       2 * (s - coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY s), 0))) AS before
         FROM r JOIN d ON r.doc_id = d.doc_id),
t AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY s) AS head, max(e) AS upto
      FROM kept GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE head || substr(h, 2 * upto + 1) END)) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
""")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    lengths = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_bytes", lengths.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        "kept_sha256")


def _spelling_sql() -> str:
    """CRC-32 from its table, which its rule makes; near words by the code point they lose."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ 0xEDB88320 if i & 1 else i >> 1
        table.append(i)
    code = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: " \
           "CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END))"
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM t GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, CAST({code} AS BIGINT[])), lambda c, b:
             xor(c // 256, list_extract(CAST({table} AS BIGINT[]), xor(c % 256, b) + 1))), 4294967295) AS h FROM r),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE len(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
                     FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM v) x),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON c.rest = v.word
      UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.rest = v.word),
b AS (SELECT word, count(*) AS n_near, min({{'down': -near_n, 'near': near}}) AS best FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
                          CASE WHEN -best.down >= 5 * v.n THEN best.near END AS form,
                          CASE WHEN -best.down >= 5 * v.n THEN -best.down END AS form_n
                   FROM v LEFT JOIN b ON v.word = b.word),
walk AS (SELECT word, form AS spot FROM f WHERE form IS NOT NULL
         UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.spot = f.word WHERE f.form IS NOT NULL),
z AS (SELECT walk.word, spot FROM walk JOIN f ON spot = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(spot, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z ON f.word = z.word
"""


@register("op11_spelling", _spelling_sql())
def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@register("op12_fill_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1,
             CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
""")
def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    text = fim.restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


@register("op13_simhash")
def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
