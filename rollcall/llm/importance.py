"""Importance resampling towards a target distribution.

Features are all runs of one and two consecutive words, hashed by CRC-32 into
buckets. The log ratio of a bucket's smoothed shares in the target and in the
corpus is its gain; a document weighs the mean gain of its features, and the
documents with the highest weight plus Gumbel noise (fixed by the id) are drawn.

CRCs are computed for the distinct features of a batch: their bytes are
gathered, by equal length, into two-dimensional uint8 arrays, all CRCs of an
array advance one column at a time, and the results are scattered back to the
features' places. Lengths with few rows (under a sixteenth of the length) go
row by row through ``zlib.crc32``, which gives the same numbers: an array of
one row and a million columns would be a million steps.

The counts of all buckets are summed over the whole corpus, one partial count a
task; the gains (``buckets`` integers) are broadcast and every document is
scored in a second scan. The draw ranks by a range partition and per-partition
offsets; no task holds all rows.

Distinct features are told apart by 64-bit hashes within a batch.

Defined results: a null or wordless text has no features and weight 0; a null id
counts as the empty text in the noise and orders last; rows with equal id and
text are ranked one after another; an empty corpus or target gives gains from
the smoothing alone.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import BASE, BETWEEN, LOWER, STEP, U, Words, chunks, mix, pieces, utf8
from .storage import ship, stage

BUCKETS = 10_000


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


TABLE = _crc_table()


def crc_matrix(columns: np.ndarray) -> np.ndarray:
    """CRC-32 of every column of a (length x texts) uint8 array."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
    for byte in columns:
        crc = TABLE[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """CRC-32 of the byte ranges, by arrays of equal length (at most ``cells``
    bytes each)."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, first[1:])):
        if len(rows) * 16 < size:
            for r in rows:
                out[r] = zlib.crc32(data[start[r]:start[r] + size])
            continue
        step = max(1, cells // max(size, 1))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            out[some] = crc_matrix(data[start[some][None, :] + np.arange(size)[:, None]])
    return out


def features(column, buckets: int = BUCKETS):
    """Yields (lo, hi, words of each document, document and bucket of every feature)."""
    for i, part in pieces(column, 1024):
        data, off = utf8(part)
        for lo, hi in chunks(off):
            w = Words(LOWER[data[off[lo]:off[hi]]], off[lo:hi + 1] - off[lo], BETWEEN)
            n, length = len(w.start), w.end - w.start
            # the words again, with one blank after each: runs are ranges of it
            at = np.append(0, np.cumsum(length + 1))
            flat = np.full(at[-1], 0x20, np.uint8)
            inner = np.arange(length.sum())
            word = np.repeat(np.arange(n), length)
            flat[inner + word] = w.data[inner - (at[:-1] - np.arange(n))[word] + w.start[word]]
            two = np.flatnonzero(w.doc[1:] == w.doc[:-1])
            h = np.concatenate([w.hash, mix(w.hash[two] * U(STEP) + w.hash[two + 1] + U(BASE))])
            start = np.concatenate([at[:-1], at[two]])
            size = np.concatenate([length, length[two] + 1 + length[two + 1]])
            _, some, which = np.unique(h, return_index=True, return_inverse=True)
            bucket = (crcs(flat, start[some], size[some]) % np.uint32(buckets)).astype(np.int64)
            yield i + lo, i + hi, w.count, np.concatenate([w.doc, w.doc[two]]), bucket[which]


def _counter(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, bucket in features(batch["text"], buckets):
                total += np.bincount(bucket, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the column ``text`` (``buckets`` numbers)."""
    rows = texts.mapInArrow(_counter(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Per bucket: floor of a thousand times the log ratio of the smoothed shares."""
    n = len(target)
    t_all, s_all = float(target.sum()) + n, float(corpus.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def _weigher(model, buckets: int):
    def run(batches):
        gain = model.value
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, words, doc, bucket in features(batch["text"], buckets):
                n = np.bincount(doc, minlength=hi - lo)
                # sums of integers far below 2**53
                total = np.bincount(doc, gain[bucket], minlength=hi - lo).astype(np.int64)
                n_words[lo:hi], n_features[lo:hi] = words, n
                weight[lo:hi] = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["key"], pa.array(n_words), pa.array(n_features), pa.array(weight)],
                ["id", "key", "n_words", "n_features", "weight"])
    return run


def ranked(rows: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """Adds the position (from 1) in the total order, without one task for all
    rows: sorted range partitions are written once, with each row's partition
    and place, and every partition starts where the ones before it end."""
    spark = rows.sparkSession
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # one row a partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r.p, before))
        before += r.n
    starts = spark.createDataFrame(starts, "__p long, __before long")
    return placed.join(F.broadcast(starts), part == F.col("__p")) \
        .withColumn(rank, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__p", "__before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             percent: int = 25, min_words: int = 20, seed: str = "7", buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; the rank is
    null where the document is not drawn."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    wanted = target.select(F.coalesce(F.col(target_text).cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(wanted, buckets), bucket_counts(rows.select("text"), buckets))
    model = spark.sparkContext.broadcast(gain)  # one integer a bucket
    weighed = rows.withColumn("key", F.xxhash64("text")).select("id", "key", "text") \
        .mapInArrow(_weigher(model, buckets), "id long, key long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stage(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "importance")
    eligible = F.col("n_words") >= min_words
    n = scored.where(eligible).count()
    draw = percent * n // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("key"), F.asc("row")]
    placed = ranked(scored.where(eligible), order)
    out = ["id", "n_words", "n_features", "weight", "score"]
    return placed.select(*out, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")) \
        .union(scored.where(~eligible).select(*out, F.lit(None).cast("long").alias("rank")))
