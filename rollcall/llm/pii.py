"""Personal data: base patterns, and bootstrapped contextual extraction.

The base patterns (email, ip, card, phone) find the seed entities. The one or
two words before a seed form lexical patterns; patterns and the identifiers
that follow them form a graph. Spark scores it iteratively: a pattern's
confidence is the score of what follows it over all its occurrences in the
corpus (a second scan counts these, whatever follows), an identifier's score
joins the confidences of its patterns, seeds stay at 1. Identifiers after
patterns of high confidence that no base pattern finds become spans of the
pattern's kind. Identifiers whose score reaches the confidence are seeds from
then on: their other contexts become patterns too, until no new one comes.

An identifier is a run of 6 to 64 non-blank characters, without surrounding
punctuation, with four digits or more, outside all base spans.

Only patterns with ``min_seeds`` different seeds are counted, in blocks of at
most ``block`` 8-byte hashes, one scan a block; the graph itself stays in Spark.

Defined results: a null text counts as empty and has no spans; rows with equal
id and text have equal spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from .arrays import Words, chunks, utf8
from .storage import empty, ship, small_batches, stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]{2,}")
_EDGE = ".,;:!?()[]{}<>\"'`=*%&$#|"
_BASE = "array<struct<kind: string, start: int, end: int>>"


def emails(text: str):
    """Leftmost non-overlapping matches, found from each @ outwards (linear)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]):
    """Identifiers outside the base spans."""
    done, taken = 0, merged((a, b, k) for k, a, b in taken)
    starts = [a for a, _, _ in taken]
    for m in _NUMBER.finditer(text):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > done and m.start() - a <= 64 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b - m.end() <= 64 and not text[b].isspace():
            b += 1
        done = b
        token = text[a:b]
        a += len(token) - len(token.lstrip(_EDGE))
        token = token.strip(_EDGE)
        b = a + len(token)
        before = bisect_left(starts, b) - 1  # the last span that starts before the end
        if 6 <= len(token) <= 64 and sum(c in "0123456789" for c in token) >= 4 \
                and (before < 0 or taken[before][1] <= a):
            yield a, b


def merged(spans) -> list[tuple[int, int, str]]:
    """Sorted intervals (start, end, kind); overlapping ones become one, of the
    first one's kind."""
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, k))
    return out


def hashes(contexts: list[str]) -> list[list[int]]:
    """Hashes of the last word and of the last two words of each context."""
    data, off = utf8(pc.utf8_lower(pa.array(contexts, pa.large_string())))
    w = Words(data, off)
    out: list[list[int]] = [[] for _ in contexts]
    for k in (1, 2):
        at, h = w.runs(k)
        last = at + k == w.first[1:][w.doc[at]] if len(at) else np.zeros(0, bool)
        for d, x in zip(w.doc[at][last].tolist(), h[last].view(np.int64).tolist()):
            out[d].append(x)
    return out


def _scan(batches):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                         ("name", pa.string()), ("patterns", pa.list_(pa.int64()))])
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            base, found, contexts = [], [], []
            for text in part["text"].to_pylist():
                own = base_spans(text) if text else []
                more = [("", a, b) for a, b in candidates(text, own)] if text else []
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                found.append([(k, a, b, text[a:b]) for k, a, b in own + more])
                contexts += [text[max(0, a - 200):a] for _, a, _ in own + more]
            seen = iter(hashes(contexts))
            mentions = [[{"kind": k or None, "start": a, "end": b, "name": n, "patterns": next(seen)}
                         for k, a, b, n in row] for row in found]
            yield pa.RecordBatch.from_arrays(
                [part["id"], part["key"], pa.array(base, pa.list_(span)), pa.array(mentions, pa.list_(mention))],
                ["id", "key", "base", "mentions"])


def _counter(wanted):
    def run(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            data, off = utf8(pc.utf8_lower(batch["text"]))
            for lo, hi in chunks(off, 1 << 18):
                w = Words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                for k in (1, 2):
                    at, h = w.runs(k)
                    x = h[at + k < w.first[1:][w.doc[at]]].view(np.int64)
                    place = np.searchsorted(wanted.value, x)
                    place[place == len(wanted.value)] = 0
                    total += np.bincount(place[wanted.value[place] == x], minlength=len(total))
        has = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted.value[has]), pa.array(total[has])], ["pattern", "total"])
    return run


def _occurrences(docs: DataFrame, patterns: DataFrame, block: int) -> DataFrame:
    """(pattern, total): how often each pattern stands before another word."""
    spark = docs.sparkSession
    n = patterns.count()
    blocks = -(-n // block)
    out = empty(spark, "pattern long, total long")
    for b in range(blocks):
        own = patterns.where(F.pmod(F.col("pattern"), F.lit(blocks)) == b).select("pattern").toArrow()
        wanted = spark.sparkContext.broadcast(np.unique(own["pattern"].to_numpy()))

        out = out.union(docs.select("text").mapInArrow(_counter(wanted), "pattern long, total long"))
    return out.groupBy("pattern").agg(F.sum("total").alias("total"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = 20,
                       confidence: float = 0.6, rounds: int = 3, block: int = 4_000_000) -> DataFrame:
    """(id, key, base, added): spans of every row; ``key`` is the xxhash64 of
    its text. ``added`` are the spans that the patterns discover."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    found = stage(rows.mapInArrow(
        _scan, f"id long, key long, base {_BASE}, mentions array<struct<kind: string, start: int, end: int, name: string, patterns: array<long>>>"), "pii")
    mention = found.select("id", "key", F.explode("mentions").alias("m")).select("id", "key", "m.*") \
        .withColumn("pattern", F.explode("patterns"))
    seeds = mention.where("kind is not null").select("pattern", "kind", "name").distinct()
    edges = known = None
    while True:
        # patterns with enough different seeds, base ones and discovered ones
        new = seeds.groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= min_seeds).select("pattern")
        new = stage(new if known is None else new.join(known, "pattern", "left_anti"), "pii-patterns")
        if known is not None and not new.head(1):
            break
        known = new if known is None else stage(known.union(new), "pii-known")
        total = stage(_occurrences(rows, new, block), "pii-total")
        graph = mention.join(new, "pattern", "left_semi").groupBy("pattern", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
        graph = stage(graph, "pii-graph")
        size = graph.groupBy("pattern").agg(F.sum("n").alias("mentioned")).join(total, "pattern", "left") \
            .select("pattern", F.greatest("mentioned", F.coalesce("total", F.lit(0))).alias("size"))
        more = graph.join(size, "pattern")
        edges = stage(more if edges is None else edges.union(more.select(*edges.columns)), "pii-edges")
        # seeds count for their own kind, other names by their score for each kind
        score = empty(spark, "name string, as_kind string, score double")
        for _ in range(rounds):
            vote = edges.where("kind is not null").select("pattern", "size", F.col("kind").alias("as_kind"), F.col("n").cast("double").alias("mass")) \
                .union(edges.where("kind is null").join(score, "name").select("pattern", "size", "as_kind", F.col("n") * F.col("score")))
            trust = vote.groupBy("pattern", "as_kind", "size").agg(F.sum("mass").alias("mass")) \
                .select("pattern", "as_kind", F.least(F.lit(0.999), F.col("mass") / F.col("size")).alias("trust"))
            trust = stage(trust.where("trust >= 0.01"), "pii-trust")
            score = stage(edges.where("kind is null").select("name", "pattern").distinct().join(trust, "pattern")
                          .groupBy("name", "as_kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score")), "pii-score")
        sure = score.where(F.col("score") >= confidence)
        if not sure.head(1):
            break
        own = mention.where("kind is null").select("pattern", "name").distinct().join(sure, "name").select("pattern", F.col("as_kind").alias("kind"), "name")
        seeds = mention.where("kind is not null").select("pattern", "kind", "name").distinct().union(own).distinct()
    best = trust.where(F.col("trust") >= confidence).groupBy("pattern") \
        .agg(F.max(F.struct("trust", "as_kind")).alias("b")).select("pattern", "b.trust", "b.as_kind")
    added = mention.where("kind is null").join(best, "pattern").groupBy("id", "key", "start", "end") \
        .agg(F.max(F.struct("trust", "as_kind")).alias("b")) \
        .groupBy(F.col("id").alias("a_id"), F.col("key").alias("a_key")) \
        .agg(F.array_sort(F.collect_set(F.struct(F.col("b.as_kind").alias("kind"), "start", "end"))).alias("added"))
    return found.join(added, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("key") == F.col("a_key")), "left") \
        .select("id", "key", "base", F.coalesce("added", F.array().cast(_BASE)).alias("added"))


def spans_text(spans) -> F.Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    rank = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("r"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(rank), lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets."""
    found = find_personal_data(docs, id_col, text_col, **options)
    hits = found.where(F.size("added") + F.size("base") > 0) \
        .select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.concat("base", "added").alias("__spans")) \
        .dropDuplicates(["__id", "__key"])

    @F.pandas_udf(StringType())
    def mask(text, spans):
        import pandas as pd

        out = []
        for t, s in zip(text, spans):
            if t is not None and s is not None:
                done, parts = 0, []
                for a, b, kind in merged((x["start"], x["end"], x["kind"]) for x in s):
                    parts += [t[done:a], f"[{kind.upper()}]"]
                    done = b
                t = "".join([*parts, t[done:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    text = F.col(text_col).cast("string")
    joined = docs.join(hits, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__key")), "left")
    return joined.select(*[F.when(F.col("__spans").isNull(), text).otherwise(mask(text, F.col("__spans"))).alias(c) if c == text_col
                           else F.col(c) for c in docs.columns])
