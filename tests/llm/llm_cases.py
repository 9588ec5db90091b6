"""Odd tables shared by the tests, and plain helpers to check against."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["id", "key", "block", "label", "score", "node", "b", "n", "m", "w", "ws", "rep", "item", "start", "h", "c"]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(vocabulary)}" + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def odd_documents(spark, extra: bool = True):
    """Null and empty texts, a very long one, ties, repeated rows, null id and
    columns; with ``extra`` also columns of clashing names."""
    a = prose(1, 120)
    rows = [(1, a, "en", "s", None), (2, a, "en", None, 5), (3, None, "fr", "s", 1), (4, "", None, "s", 1),
            (5, " \n\t", "en", "s", 1), (6, "one two", "de", "s", 1), (7, prose(2, 30000), "en", "s", 1),
            (8, a.replace("word1", "Word1"), "en", "s", 1), (9, prose(3, 60), None, None, None),
            (9, prose(3, 60), None, None, None), (9, prose(4, 60), "en", "s", 2), (None, prose(5, 70), "en", "s", 3),
            (None, a, "en", "s", 3), (None, None, None, None, None), (12, "é" * 3000 + " ß 日本語", "xx", "s", 1),
            (13, "a@b.co 1.2.3.4 x 4111 1111 1111 1111 +1 (234) 567-8901", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASHING}) if extra else df


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def tied_documents(spark):
    """A repeated id and null with most rows, many of them equal."""
    rng = random.Random(8)
    rows = [(i, prose(i, 20)) for i in range(60)]
    rows += [(30, prose(rng.randrange(500, 560), 20)) for _ in range(300)] + [(30, prose(30, 20))] * 50
    rows += [(None, prose(rng.randrange(540, 600), 20)) for _ in range(300)] + [(None, None), (None, ""), (30, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, None, 0), (None, 1, 1), (7, 1, None), (99, 1, 1), (8, 0, 0)],
                                 "doc_id long, quality int, toxic int")


def shingle_counts(text, k=5, split=re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")):
    w = [x for x in split.split((text or "").lower()) if x]
    return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def probability_jaccard(a, b):
    if not a or not b:
        return float(a == b)
    if set(a.values()) == set(b.values()) == {1}:
        return len(set(a) & set(b)) / len(set(a) | set(b))
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[k], b[j] / b[k]) for j in keys) for k in set(a) & set(b))
