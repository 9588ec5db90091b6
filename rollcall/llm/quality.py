"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are binned measures of the
line (length, words, repeats, shares of symbols, capitals, digits, ...) and the
same measures of the lines before and after it; learned transitions join the
labels. Forward-backward gives each line the probability of being good, and the
mean of these, weighted by the lines' letters and signs, is the document's score.

Training: a bounded sample of labelled documents of each class; a document's
label stands for each of its lines. The likelihood is maximised by Adagrad. A
logistic curve, fitted to the same documents, turns the mean into the chance
that the document's label is good.

A document is one chain, whatever its length; for training it is cut into pieces
of ``WIDTH`` lines.

Defined results: blank lines are no lines; a text without lines (null, empty,
blanks) has the score of one empty line; without labelled rows of both classes
every score is the share of class 1 (0.5 without rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U, Words, chunks, code_points, mix, not_letter, not_word, pieces
from .crf import Adagrad, forward_backward, lay_out, marginals
from .labelled import sample
from .storage import ship, small_batches
from .toxicity import SPACES

WIDTH, BINS = 64, 8
NEWLINE = np.zeros(0x110000, bool)
NEWLINE[[10, 13]] = True
#: Upper edges of the bins of each measure.
SHARES = (0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6)
EDGES = [(2, 8, 20, 60, 200, 600, 2000), (1, 2, 4, 10, 30, 100, 400), (2, 3, 4, 5, 6.5, 8, 12),
         *[SHARES] * 9]


def upper(points: np.ndarray) -> np.ndarray:
    """ASCII, Latin-1, Greek and Cyrillic capitals."""
    p = points
    return ((p >= 65) & (p <= 90)) | ((p >= 0xC0) & (p <= 0xDE) & (p != 0xD7)) | ((p >= 0x391) & (p <= 0x42F))


def _lines(column):
    """Yields (lo, hi, line's document, line's weight, lines x measures)."""
    for i, part in pieces(column):
        points, off = code_points(part)
        for lo, hi in chunks(off, 1 << 18):
            doc, chars, measures = _measures(points[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            yield i + lo, i + hi, doc, chars, measures


def _measures(p: np.ndarray, o: np.ndarray):
    """(line's document, line's weight, lines x measures) of a chunk."""
    w = Words(p, o, SPACES)
    line = Words(p, o, NEWLINE)
    of = np.searchsorted(line.start, w.start, "right") - 1  # the line of each word
    words = np.bincount(of, minlength=len(line.start))
    keep = words > 0
    number = np.cumsum(keep) - 1
    n, of, words = int(keep.sum()), number[of], words[keep]
    start, end, doc, same = line.start[keep], line.end[keep], line.doc[keep], line.hash[keep]
    length = (end - start).astype(float)

    def total(flag):
        c = np.append(0, np.cumsum(flag))
        return (c[end] - c[start]).astype(float)

    letter = ~not_letter()[p]
    space = SPACES[p]
    sign = not_word()[p] & ~space
    chars = np.maximum(length - total(space), 1)
    again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1]))
    pair = mix(w.hash + U(0x9E37) * of.astype(U))
    first = np.zeros(len(w.hash), bool)
    first[np.unique(pair, return_index=True)[1]] = True
    one_sign = np.zeros(len(w.hash), bool)
    short = (w.end - w.start) == 1
    one_sign[short] = sign[w.start[short]]
    tail = sign[w.end - 1] & (w.end - w.start >= 3) if len(w.hash) else np.zeros(0, bool)
    tail[tail] = sign[w.end[tail] - 2]
    by_word = lambda flag: np.bincount(of, flag, minlength=n) / words
    whole = mix(same + U(0x51ED) * doc.astype(U))
    _, inverse, times = np.unique(whole, return_inverse=True, return_counts=True)
    repeated = (times[inverse] > 1).astype(float) if n else np.zeros(0)
    # runs of capitals count, not one capital that starts a word
    cap = upper(p)
    inner = cap & np.append(False, cap[:-1])
    inner[line.start] = False  # the text before may end with a capital
    measures = [length, words, chars / words, total(sign) / chars, total(inner) / chars,
                total(letter) / chars, total(~letter & ~space & ~sign) / chars,
                by_word(again), 1 - by_word(first), by_word(one_sign), by_word(tail), repeated]
    return doc, chars, np.stack(measures, axis=1) if n else np.zeros((0, len(EDGES)))


def _features(doc: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """lines x (3 x measures) indices of the active bins: the line's, those of
    the line before and after (bin 0 of an own range where there is none)."""
    n, m = measures.shape
    own = np.stack([np.searchsorted(EDGES[j], measures[:, j], "right") for j in range(m)], axis=1) if n else measures.astype(int)
    own = own + 1 + np.arange(m) * (BINS + 1)
    none = np.arange(m) * (BINS + 1)
    before, after = np.tile(none, (n, 1)), np.tile(none, (n, 1))
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    span = m * (BINS + 1)
    return np.concatenate([own, before + span, after + 2 * span], axis=1)


N_FEATURES = 3 * len(EDGES) * (BINS + 1)


def _chains(doc: np.ndarray, n_docs: int):
    return lay_out(np.bincount(doc, minlength=n_docs), WIDTH)


def fit(texts, labels, epochs: int = 8, rate: float = 0.3):
    """(weight of each feature for "good", transitions, (slope, offset) of the
    curve, share of good)."""
    y = np.asarray(labels, int)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return None, None, None, share
    order = np.random.default_rng(1).permutation(len(y))
    texts, y = texts.take(pa.array(order)), y[order]
    parts = [(doc, _features(doc, m), lo, hi) for lo, hi, doc, _, m in _lines(texts)]
    w, trans = Adagrad(N_FEATURES, rate, 1e-4), Adagrad((2, 2), rate, 1e-4)
    for _ in range(epochs):
        for doc, f, lo, hi in parts:
            if not len(doc):
                continue
            row, col, size = _chains(doc, hi - lo)
            score = np.zeros((int(size.max()), len(size), 2))
            score[col, row, 1] = w.w[f].sum(axis=1)
            g, pairs = forward_backward(score, size, trans.w, pairs=True)
            truth = y[lo + doc]
            err = g[col, row, 1] - truth
            w.step(np.bincount(f.ravel(), np.repeat(err, f.shape[1]), minlength=N_FEATURES) / len(doc))
            inside = (col[1:] > 0)
            np.subtract.at(pairs, (truth[:-1][inside], truth[1:][inside]), 1)
            trans.step(pairs / len(doc))
    return w.w, trans.w, _curve(_means(texts, w.w, trans.w), y), share


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _curve(mean: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1.0):
    """Slope and offset of the logistic curve over the log odds (Newton)."""
    x, t = np.column_stack([_log_odds(mean), np.ones(len(y))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        t = t - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - y) + ridge * (t - [1, 0]))
    return float(max(t[0], 0.0)), float(t[1])


def line_marginals(column, weights, trans):
    """Yields (lo, hi, line's document, line's weight, probability of good)."""
    for lo, hi, doc, weight, measures in _lines(column):
        if not len(doc):
            yield lo, hi, doc, weight, np.zeros(0)
            continue
        row, col, size = _chains(doc, hi - lo)
        score = np.zeros((int(size.max()), len(size), 2))
        score[col, row, 1] = weights[_features(doc, measures)].sum(axis=1)
        pieces_ = -(-np.bincount(doc, minlength=hi - lo) // WIDTH)
        yield lo, hi, doc, weight, marginals(score, size, trans, pieces_)[col, row, 1]


def _means(column, weights, trans) -> np.ndarray:
    """Of every text, the weighted mean of its lines' marginals."""
    empty = weights[_features(np.zeros(1, int), np.zeros((1, len(EDGES))))].sum()
    out = np.full(len(column), 1 / (1 + np.exp(-np.clip(empty, -30, 30))))
    for lo, hi, doc, weight, good in line_marginals(column, weights, trans):
        total = np.bincount(doc, weight, minlength=hi - lo)
        has = total > 0
        out[lo:hi][has] = np.bincount(doc, weight * good, minlength=hi - lo)[has] / total[has]
    return out


def score(column, weights, trans, curve, share: float) -> np.ndarray:
    if weights is None:
        return np.full(len(column), share)
    z = curve[0] * _log_odds(_means(column, weights, trans)) + curve[1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", label_id: str = "doc_id", bound: int = 3000, keep: tuple = ()) -> DataFrame:
    """(id, score, and the columns named in ``keep``) of every text. ``labels``
    are the rows to learn from; at most ``bound`` of each class are used."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    keys = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    texts, y, _ = sample(docs, keys.where("label in (0, 1)"), bound, id_col, text_col)
    model = spark.sparkContext.broadcast(fit(texts, y))  # a few hundred floats

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                s = pa.array(score(part["__text"], *model.value))
                yield pa.RecordBatch.from_arrays([*(c for c, n in zip(part.columns, part.schema.names) if n != "__text"), s], names)

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), *[F.col(c).alias(f"__keep_{c}") for c in keep],
                       F.col(text_col).cast("string").alias("__text"))
    names = [*(c for c in rows.columns if c != "__text"), "score"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + ", score double"
    out = rows.mapInArrow(run, shape)
    return out.select(F.col("__id").alias("id"), "score", *[F.col(f"__keep_{c}").alias(c) for c in keep])
