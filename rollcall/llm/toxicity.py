"""Toxicity from subword bags.

A word is the bag of its character n-grams and itself, hashed into a table of
embeddings; a text is the mean of its words' vectors (a repeated word counts by
the root of its frequency, and ``PRIOR`` neutral words join); a linear softmax
reads the mean. Embeddings and softmax are trained together by Adagrad in numpy, on a
bounded sample of labelled rows, so a misspelling shares the vectors of the
n-grams it keeps. Scoring folds table and softmax into one number per bucket
and runs as a map over whole texts: no shuffle.

Defined results: a text without words (null, empty, blanks) gets the score of
the bias alone; without labelled rows of both classes every score is the share
of class 1 (0.5 without rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import SPACE, Words, chunks, code_points, ngrams, pieces
from .crf import Adagrad
from .labelled import sample
from .storage import ship

BITS, SIZES, DIM, SCALE = 17, (3, 4, 5), 8, 32.0
#: Neutral words added to every text, so that a few words do not decide alone.
PRIOR = 10.0
SPACES = np.zeros(0x110000, bool)
SPACES[:256] = SPACE


def _words(column):
    """Yields (lo, hi, words, index of each word among the distinct ones, the
    distinct words' (word, bucket) features) per chunk of lower-cased text."""
    for i, part in pieces(column):
        points, off = code_points(part, lower=True)
        for lo, hi in chunks(off, 1 << 18):
            w = Words(points[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], SPACES)
            _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
            yield i + lo, i + hi, w, which, ngrams(w.data, w.start[first], w.end[first], SIZES, BITS)


def _shares(w: Words, which: np.ndarray, n: int):
    """(document, distinct word, share) of every distinct word of a document."""
    pair, times = np.unique(w.doc * n + which, return_counts=True)
    doc, often = pair // max(n, 1), np.sqrt(times)
    total = np.bincount(doc, often, minlength=len(w.count)) + PRIOR
    return doc, pair - doc * n, often / total[doc]


def _bags(column):
    """Per chunk: the first text, and by (text, bucket): text, bucket, weight in
    the mean of the text's words."""
    for lo, hi, w, which, (word, bucket) in _words(column):
        n = int(which.max(initial=-1)) + 1
        doc, own, share = _shares(w, which, n)
        count = np.bincount(word, minlength=n)
        bucket, at = bucket[np.argsort(word, kind="stable")], np.append(0, np.cumsum(count))
        k = count[own]
        take = np.arange(k.sum()) - np.repeat(np.append(0, np.cumsum(k))[:-1], k) + np.repeat(at[own], k)
        cell, inverse = np.unique((np.repeat(doc, k) << BITS) + bucket[take], return_inverse=True)
        weight = np.bincount(inverse, np.repeat(share / np.maximum(k, 1), k), minlength=len(cell))
        yield lo, hi, cell >> BITS, (cell & ((1 << BITS) - 1)).astype(np.int32), weight.astype(np.float32)


def fit(texts, labels, epochs: int = 6, batch: int = 64, rate: float = 0.1, seed: int = 1, min_texts: int = 5, decay: float = 3e-6):
    """One number per bucket and the bias: the difference of the two logits.
    Buckets seen in fewer than ``min_texts`` training texts stay neutral."""
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    rng, seen = np.random.default_rng(seed), np.zeros(1 << BITS, np.int64)
    for _, _, _, b, _ in _bags(texts):
        seen += np.bincount(b, minlength=1 << BITS)
    size, buckets, weights = [], [], []
    for lo, hi, doc, b, c in _bags(texts):
        known = seen[b] >= min_texts
        size.append(np.bincount(doc[known], minlength=hi - lo))
        buckets.append(b[known])
        weights.append(c[known])
    buckets, weights = np.concatenate(buckets), np.concatenate(weights)
    at = np.append(0, np.cumsum(np.concatenate(size)))
    e = Adagrad((DIM, 1 << BITS), rate, decay)
    e.w[:] = rng.normal(0, 0.05, e.w.shape)
    soft = Adagrad((2, DIM + 1), rate)
    soft.w[:] = rng.normal(0, 0.3, soft.w.shape)
    target = np.stack([1 - y, y], axis=1)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            rows = order[lo:lo + batch]
            b = np.concatenate([buckets[at[i]:at[i + 1]] for i in rows])
            c = np.concatenate([weights[at[i]:at[i + 1]] for i in rows]) * SCALE
            r = np.repeat(np.arange(len(rows)), at[rows + 1] - at[rows])
            used, place = np.unique(b, return_inverse=True)
            part = e.w[:, used]
            h = np.stack([np.bincount(r, part[k, place] * c, minlength=len(rows)) for k in range(DIM)], axis=1)
            z = h @ soft.w[:, :DIM].T + soft.w[:, DIM]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            err = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = err @ soft.w[:, :DIM]
            soft.step(np.column_stack([err.T @ h, err.sum(axis=0)]))
            for k in range(DIM):
                g = np.bincount(place, back[r, k] * c, minlength=len(used)) + e.decay * part[k]
                e.g[k, used] += g * g
                e.w[k, used] -= rate * g / np.sqrt(e.g[k, used])
    diff = soft.w[1] - soft.w[0]
    e.w[:, seen < min_texts] = 0
    return (diff[:DIM] @ e.w).astype(np.float32) * np.float32(SCALE), float(diff[DIM])


def score(column, value: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(column), bias)
    for lo, hi, w, which, (word, bucket) in _words(column):
        n = int(which.max(initial=-1)) + 1
        per_word = np.bincount(word, value[bucket], minlength=n) / np.maximum(np.bincount(word, minlength=n), 1)
        doc, own, share = _shares(w, which, n)
        out[lo:hi] += np.bincount(doc, share * per_word[own], minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", label_id: str = "doc_id", bounds: tuple = (5000, 2500)) -> DataFrame:
    """(id, score) of every text. ``labels`` are the rows to learn from; at most
    ``bounds`` of class 0 and 1 are used."""
    spark = docs.sparkSession
    ship(spark)
    keys = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    texts, y, _ = sample(docs, keys.where("label in (0, 1)"), dict(enumerate(bounds)), id_col, text_col)
    model = spark.sparkContext.broadcast(fit(texts, y))  # 2**17 floats

    def run(batches):
        value, bias = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(score(part["text"], value, bias))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, score double")
