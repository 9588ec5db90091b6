"""Language of words and texts by a linear-chain conditional random field.

Words are runs of letters. A word's score for each language sums learned
weights of hashed features: prefixes and suffixes, character n-grams, and the
word itself (the lexicon). Learned transitions join neighbouring words, and
forward-backward gives every word its posterior, so a text may switch language.
A text's language has the largest mean posterior, which is the score.

Training: whole labelled texts (a bounded sample of each language) are cut into
pieces, and pieces of different texts are joined, so that the chains contain
switches; the conditional likelihood is maximised by Adagrad in numpy.

A text is one chain, whatever its length; training chains have ``WIDTH`` words.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without labelled rows every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import Words, chunks, code_points, ngrams, not_letter, pieces
from .crf import Adagrad, forward_backward, lay_out, marginals
from .labelled import sample
from .storage import ship

BITS, SIZES, AFFIXES, WIDTH, PIECE = 16, (2, 3), (2, 3), 64, 12


def _words(column):
    """Yields (lo, hi, words, index of each word among the distinct ones, the
    distinct words' (word, bucket) features) per chunk of lower-cased text."""
    for i, part in pieces(column):
        points, off = code_points(part, lower=True)
        for lo, hi in chunks(off, 1 << 18):
            w = Words(points[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], not_letter())
            _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
            yield i + lo, i + hi, w, which, ngrams(w.data, w.start[first], w.end[first], SIZES, BITS, AFFIXES)


def _scores(weights: np.ndarray, word: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(word, col[bucket], minlength=n) for col in weights], axis=1)


def fit(texts, labels: list, classes: list, epochs: int = 3, rate: float = 0.2, batch: int = 64, seed: int = 1):
    """(labels x buckets weights, label transitions)."""
    k, rng = len(classes), np.random.default_rng(seed)
    code = np.array([classes.index(x) for x in labels])
    w, trans = Adagrad((k, 1 << BITS), rate, 1e-6), Adagrad((k, k), rate, 1e-5)
    for _ in range(epochs):
        for lo, hi, words, which, (word, bucket) in _words(texts):
            n = int(which.max(initial=-1)) + 1
            if not n:
                continue
            order = np.argsort(word, kind="stable")
            bucket, count = bucket[order], np.bincount(word, minlength=n)
            at = np.append(0, np.cumsum(count))
            # pieces of up to PIECE words in random order, joined to chains of WIDTH
            row, col, size = lay_out(words.count, PIECE)
            rank = rng.permutation(len(size))
            place = np.argsort(rank[row] * PIECE + col, kind="stable")
            items, truth = which[place], code[lo + words.doc[place]]
            for s in range(0, len(items), batch * WIDTH):
                it, y = items[s:s + batch * WIDTH], truth[s:s + batch * WIDTH]
                row, col, size = lay_out(np.array([len(it)]), WIDTH)
                used, inv = np.unique(it, return_inverse=True)
                c = count[used]
                take = np.arange(c.sum()) - np.repeat(np.append(0, np.cumsum(c))[:-1], c) + np.repeat(at[used], c)
                b, owner = bucket[take], np.repeat(np.arange(len(used)), c)
                score = np.zeros((int(size.max()), len(size), k))
                score[col, row] = _scores(w.w, owner, b, len(used))[inv]
                g, pairs = forward_backward(score, size, trans.w, pairs=True)
                err = g[col, row]
                err[np.arange(len(it)), y] -= 1
                per_word = np.stack([np.bincount(inv, err[:, j], minlength=len(used)) for j in range(k)])
                w.step(np.stack([np.bincount(b, per_word[j][owner], minlength=1 << BITS) for j in range(k)]) / len(it))
                inside = col[1:] > 0
                np.subtract.at(pairs, (y[:-1][inside], y[1:][inside]), 1)
                trans.step(pairs / len(it))
    return w.w.astype(np.float32), trans.w


def word_posteriors(column, weights: np.ndarray, trans: np.ndarray):
    """Yields (lo, hi, words, words x languages posteriors)."""
    for lo, hi, w, which, (word, bucket) in _words(column):
        n = int(which.max(initial=-1)) + 1
        if not n:
            yield lo, hi, w, np.zeros((0, len(weights)))
            continue
        row, col, size = lay_out(w.count, WIDTH)
        score = np.zeros((int(size.max()), len(size), len(weights)), np.float32)
        score[col, row] = _scores(weights, word, bucket, n)[which]
        yield lo, hi, w, marginals(score, size, trans, -(-w.count // WIDTH))[col, row]


def predict(column, weights, trans, classes: list) -> tuple[list[str], np.ndarray]:
    names, best = [], np.zeros(len(column))
    for lo, hi, w, g in word_posteriors(column, weights, trans):
        total = np.stack([np.bincount(w.doc, g[:, j], minlength=hi - lo) for j in range(len(classes))], axis=1)
        mean = total / np.maximum(w.count, 1)[:, None]
        top = mean.argmax(axis=1)
        best[lo:hi] = np.clip(mean.max(axis=1), 0, 1)
        names += [classes[t] if c else "und" for t, c in zip(top, w.count)]
    return names, best


def languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", bound: int = 600) -> DataFrame:
    """(id, lang_pred, score) of every text. ``labelled``: rows whose text and
    language may be learnt; at most ``bound`` of each language are used."""
    spark = docs.sparkSession
    ship(spark)
    keys = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("label"))
    texts, y, classes = sample(labelled, keys, bound, id_col, text_col)
    weights, trans = fit(texts, y, classes) if classes else (None, None)
    model = spark.sparkContext.broadcast((weights, trans, classes))  # languages x 2**16 floats

    def run(batches):
        weights, trans, classes = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                names, best = predict(part["text"], weights, trans, classes) if classes else \
                    (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(names, pa.string()), pa.array(best)],
                                                 ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, lang_pred string, score double")
