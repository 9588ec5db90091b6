"""Registered queries of this package: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# DuckDB: windows as lists of words, compared whole.
ORACLES["op4_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], chr(31))) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g
  FROM win JOIN firsts USING (h) WHERE m < doc_id GROUP BY doc_id),
cut AS (SELECT w.doc_id, ws, coalesce(g, []) AS g FROM w LEFT JOIN gone USING (doc_id)),
kept AS (
  SELECT doc_id, ws, g, CASE WHEN len(g) = 0 THEN ws ELSE
    (SELECT coalesce(list(ws[k] ORDER BY k), []) FROM (SELECT unnest(range(1, len(ws) + 1)) AS k) t
     WHERE NOT list_contains(g, k)) END AS kw FROM cut)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed,
       sha256(array_to_string(kw, ' ')) AS kept_sha256 FROM kept
"""


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out

    return read(spark, sf_dir, "labels").where(~held_out())


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out
    from .toxicity import toxicity

    out = toxicity(read(spark, sf_dir, "documents"), _learnable(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edited_pairs

    return edited_pairs(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out
    from .quality import quality

    out = quality(read(spark, sf_dir, "documents"), _learnable(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    return format_conversations(read(spark, sf_dir, "conversations")).withColumnRenamed("id", "conv_id")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out
    from .langid import languages

    docs = read(spark, sf_dir, "documents")
    out = languages(docs, docs.where(~held_out()))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


# Turns as a list; a conversation goes if a longer one starts with all its turns.
ORACLES["op8_chat_format"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, CASE WHEN conv_id IS NOT NULL THEN turn END AS turn,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS ts
  FROM t GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN {'r': role, 't': text} END),
p AS (SELECT DISTINCT ts[1:k] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM c)),
one AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ts)
SELECT conv_id, CAST(len(ts) AS BIGINT) AS n_turns, n_copies,
  array_to_string(list_transform(ts, lambda x: '<|im_start|>'
    || replace(replace(x.r, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
    || replace(replace(x.t, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
    || '<|im_end|>' || chr(10)), '') AS text
FROM one WHERE ts NOT IN (SELECT ts FROM p)
"""


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, spans_text

    out = find_personal_data(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias("doc_id"), *counts,
                      F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      spans_text(F.concat("base", "added")).alias("spans"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import flagged

    out = flagged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "contaminated", "n_items", F.array_join("items", ",").alias("items"), "similarity")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("key").withColumnRenamed("id", "doc_id")


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "class_size")


# Every item-sized window of every document that shares a shingle with the item.
_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_RUNS = "list_transform(range(1, greatest(len({w}) - {k} + 1, 1) + 1), lambda p: array_to_string({w}[p:p + {k} - 1], ' '))"
ORACLES["op6_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, ws, len(ws) AS l, least(5, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
ish AS (SELECT item_id, k, unnest({_RUNS.format(w='ws', k='k')}) AS s FROM i),
dsh AS (SELECT DISTINCT doc_id, k, s FROM (SELECT doc_id, k, unnest({_RUNS.format(w='ws', k='k')}) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(ws) > 0)),
pair AS (SELECT DISTINCT doc_id, item_id FROM dsh JOIN ish USING (k, s)),
win AS (SELECT doc_id, item_id, l, k, d.ws, unnest(range(0, greatest(len(d.ws) - l, 0) + 1)) AS st
        FROM pair JOIN d USING (doc_id) JOIN i USING (item_id)),
wsh AS (SELECT doc_id, item_id, st, unnest({_RUNS.format(w='ws[st + 1:st + l]', k='k')}) AS s FROM win),
wc0 AS (SELECT doc_id, item_id, st, s, count(*) AS x FROM wsh GROUP BY doc_id, item_id, st, s),
wc AS (SELECT *, sum(x) OVER (PARTITION BY doc_id, item_id, st) AS nx FROM wc0),
ic0 AS (SELECT item_id, s, count(*) AS y FROM ish GROUP BY item_id, s),
ic AS (SELECT *, sum(y) OVER (PARTITION BY item_id) AS ny FROM ic0),
sim AS (SELECT doc_id, item_id, st, sum(least(x, y)) AS m, any_value(nx) AS nx, any_value(ny) AS ny FROM wc JOIN ic USING (item_id, s) GROUP BY doc_id, item_id, st),
hit AS (SELECT doc_id, item_id, max(CAST(m AS BIGINT) / CAST(nx + ny - m AS BIGINT)) AS similarity FROM sim GROUP BY doc_id, item_id),
per AS (SELECT doc_id, count(*) AS n, array_to_string(list(item_id ORDER BY item_id), ',') AS items, max(similarity) AS similarity
        FROM hit WHERE similarity >= 0.8 GROUP BY doc_id)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, coalesce(items, '') AS items, coalesce(similarity, 0.0) AS similarity
FROM documents LEFT JOIN per USING (doc_id)
"""


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_shared_lines

    out = drop_shared_lines(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op11_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, {_LOWER.format("trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM l),
c AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
r AS (SELECT doc_id, i, x, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import ranked_search

    out = ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
tot AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) GROUP BY doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM f, tot GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (t) JOIN w USING (t), tot GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


# CRC-32 by its bitwise rule: a table of 256 entries, then one step a byte.
_WORDS13 = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS13 = "list_concat(ws, list_transform(range(1, len(ws)), lambda p: ws[p] || ' ' || ws[p + 1]))"
ORACLES["op13_importance_resampling"] = f"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
       lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(b AS BIGINT))) AS tab),
d AS (SELECT doc_id, {_WORDS13} AS ws FROM documents),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest({_RUNS13}) AS f FROM d) GROUP BY doc_id, f),
tf AS (SELECT f, count(*) AS n FROM (SELECT unnest({_RUNS13}) AS f FROM (SELECT {_WORDS13} AS ws FROM benchmark)) GROUP BY f),
b AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST(('0x' || hex(encode(f))[2 * i + 1:2 * i + 2]) AS BIGINT)),
        lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS b
      FROM (SELECT f FROM df UNION SELECT f FROM tf), tab),
s AS (SELECT b, sum(n) AS n FROM df JOIN b USING (f) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM tf JOIN b USING (f) GROUP BY b),
tot AS (SELECT (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM s) AS s_all, (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM t) AS t_all),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + CAST(1 AS DOUBLE)) * (s_all + 10000) / ((s.n + CAST(1 AS DOUBLE)) * (t_all + 10000)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (b), tot),
w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM df JOIN b USING (f) JOIN g USING (b) GROUP BY doc_id),
x AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features,
        coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
        CAST(('0x' || sha256('7:' || doc_id)[1:8]) AS BIGINT) AS h
      FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)
"""
