"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as _bench
from . import filter_audit as _audit
from . import html_extract as _html
from . import importance as _weights
from . import line_dedup as _line
from . import minhash as _near
from . import quality_classifier as _quality
from . import quality_rules as _rules
from . import secret_scan as _secrets
from . import sentencepiece_bpe as _piece
from . import token_store as _tokens
from . import toxicity as _toxic
from . import url_filter as _urls
from ._shared import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _secrets.scan_secrets(docs, model_file=vocabulary("piece_bpe_32k.model"), path_col="source")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _line.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: The tables hold no list and no fetch times; the query derives both from the
#: pages: a date from page_id, and entries from each host's letters.
_LIST = """
WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:@]+)', 1)) AS host FROM pages WHERE url IS NOT NULL),
n AS (SELECT host, length(host) * 37 + ascii(host) * 11 + ascii(substr(host, 4, 1)) * 5 + ascii(substr(host, 7, 1)) * 3 AS n FROM h WHERE host <> ''),
p AS (SELECT regexp_replace(host, '^[^.]*[.]', '') AS value, min(n) AS n FROM n WHERE length(host) - length(replace(host, '.', '')) >= 3 GROUP BY 1)
SELECT 'host' AS kind, host AS value, CAST(n % 200 AS INT) AS day, 'block' AS action FROM n WHERE n % 3 = 0
UNION ALL SELECT 'host', host, CAST(n % 200 + 40 AS INT), 'remove' FROM n WHERE n % 6 = 0
UNION ALL SELECT 'host', host, CAST(n % 200 + 90 AS INT), 'allow' FROM n WHERE n % 12 = 0
UNION ALL SELECT 'domain', value, CAST(n % 150 AS INT), 'block' FROM p WHERE n % 2 = 0
UNION ALL SELECT 'prefix', concat(host, '/en'), CAST(n % 300 AS INT), 'allow' FROM n WHERE n % 4 = 0
UNION ALL SELECT 'prefix', concat(host, '/de'), CAST(n % 250 AS INT), 'block' FROM n WHERE n % 5 = 0
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    entries = spark.sql(_LIST.replace("FROM pages", "FROM {pages}"), pages=pages)
    entries = entries.withColumn("since", F.expr("date_add(DATE'2024-01-01', day)"))
    captures = pages.withColumn("fetched", F.expr("date_add(DATE'2024-01-01', CAST(page_id * 7919 % 366 AS INT))"))
    # dates leave as text
    out = _urls.filter_urls(captures, entries)
    day = "yyyy-MM-dd"
    return out.select(
        "page_id", "url", F.date_format("fetched", day).alias("fetched"), "host", "verdict", "entry_kind", "entry_value",
        F.date_format("entry_since", day).alias("entry_since"),
    )


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    _tokens.write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return _tokens.read_checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract_main_text(_table(spark, sf_dir, "pages"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piece.digests(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _rules.quality_rules(docs, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "language",
        "chars_per_token", "byte_share", "entropy_share", "byte_chars_per_token", "byte_byte_share", "byte_entropy_share",
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxic.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _weights.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=1, buckets=10000, least_words=20, percent=10, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _crc_entry(x: int) -> int:
    for _ in range(8):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


#: crc32 in SQL: byte by byte through its table, once for each distinct word.
_CRC_TABLE = "[" + ", ".join(str(_crc_entry(b)) for b in range(256)) + "]::BIGINT[]"
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = "list_filter(string_split_regex(" + _LOWER_SQL + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_token_store": op4_token_store,
    "op5_html_extract": op5_html_extract,
    "op6_near_dedup": op6_near_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_toxicity": op11_toxicity,
    "op12_importance": op12_importance,
    "op13_filter_audit": op13_filter_audit,
}

SQL = {
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, line, pos,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op3_url_filter": r"""
WITH e0 AS ("""
    + _LIST
    + r"""),
e AS (SELECT kind, value, DATE '2024-01-01' + day AS since,
             max(CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS act
      FROM e0 GROUP BY 1, 2, 3),
i AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM e),
c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INT) AS fetched,
             nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
             lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '')) AS path
      FROM pages),
v AS (SELECT c.*, 4 AS rank, 'url' AS kind, host || path AS value FROM c WHERE host IS NOT NULL
      UNION ALL SELECT c.*, 3, 'prefix', unnest(list_transform(range(1, len(string_split(host || path, '/')) + 1), lambda k: array_to_string(string_split(host || path, '/')[1:k], '/'))) FROM c WHERE host IS NOT NULL
      UNION ALL SELECT c.*, 2, 'host', host FROM c WHERE host IS NOT NULL
      UNION ALL SELECT c.*, 1, 'domain', unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))) FROM c WHERE host IS NOT NULL),
m AS (SELECT v.page_id, i.kind, i.value, i.since, i.act, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, length(v.value) DESC) AS r
      FROM v JOIN i ON v.kind = i.kind AND v.value = lower(i.value) AND i.since <= v.fetched AND (i.until IS NULL OR v.fetched < i.until)
      WHERE i.act > 0)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, c.host,
       CASE m.act WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict,
       m.kind AS entry_kind, m.value AS entry_value, strftime(m.since, '%Y-%m-%d') AS entry_since
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1
""",
    "op5_html_extract": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|<footer|$)', 1, 's') AS art FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(art, '</?b>', '', 'g'), '</?(?:p|h1|br)>'),
        lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS ls FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(ls, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
""",
    "op12_importance": r"""
WITH k AS (SELECT """ + _CRC_TABLE + r""" AS crcs),
d AS (SELECT doc_id, """ + _WORDS_SQL + r""" AS ws FROM documents),
b AS (SELECT """ + _WORDS_SQL + r""" AS ws FROM benchmark),
u AS (SELECT doc_id, unnest(ws) AS w FROM d),
v AS (SELECT unnest(ws) AS w FROM b),
h0 AS (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT) AS bytes FROM (SELECT w FROM u UNION SELECT w FROM v)),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(crcs[xor(c & 255, x) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM h0, k),
s AS (SELECT bucket, count(*) AS s FROM u JOIN h USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM v JOIN h USING (w) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gained FROM u JOIN h USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features,
             coalesce((gained - ((gained % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM y LEFT JOIN z USING (doc_id)
""",
    "op13_filter_audit": r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(ws) < 200, 100 * list_unique(ws) < 50 * len(ws), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
      WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
s AS (SELECT o.o, x.i AS step, m.*, m.fails[o.o[x.i]] AS own, len(list_filter(o.o[1:x.i - 1], lambda k: m.fails[k])) > 0 AS gone,
             len(list_filter(m.fails, lambda v: v)) AS n_fails FROM m, o, x)
SELECT part, array_to_string(list_transform(o, lambda k: chr((64 + k)::INT)), '') AS filter_order, step::INT AS step,
       sum(CASE WHEN NOT gone AND NOT own THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN own THEN n * 120 // n_fails ELSE 0 END)::BIGINT AS shapley
FROM s GROUP BY 1, 2, 3
""",
}
