"""Line dedup, ranked search and importance resampling against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import SCHEMA, empty_documents, odd_documents, prose
from rollcall.llm import importance, lines, ranking

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# lines

def plain_lines(rows, min_docs=5, min_chars=40):
    held = defaultdict(set)
    order = lambda i: -math.inf if i is None else i
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    for i, ls in cut:
        for x in ls:
            k = x.strip(BLANK).translate(LOW)
            if len(k) >= min_chars:
                held[k].add(order(i))
    out = []
    for i, ls in cut:
        stay = [x for x in ls if not (len(held.get(k := x.strip(BLANK).translate(LOW), ())) >= min_docs and max(held[k]) != order(i))]
        out.append((str(i), len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out)


def own_lines(docs, **options):
    return sorted((str(r.id), r.n_lines, r.n_dropped, r.kept) for r in lines.drop_shared_lines(docs, **options).collect())


LICENSE = "Permission is hereby granted to any person who asks nicely"


def line_rows():
    rows = [(i, f"a {i}\n{LICENSE}\n" + ("\t" + LICENSE.upper() + " \r" if i % 2 else "") + f"\nend {i}") for i in range(30)]
    rows += [(100 + i, "x" * 39 + f"\n{i}") for i in range(6)]            # a code point too short
    rows += [(110 + i, "é" * 20 + "ß" * 20 + f"\n{i}") for i in range(5)]  # 40 code points, 80 bytes
    rows += [(120 + i, "É" * 40 + f"\n{i}") for i in range(4)]             # other case, not A-Z: another key; four documents
    rows += [(130, "\n".join([LICENSE + " again"] * 9)), (131, LICENSE + " again")]  # many lines, two documents
    rows += [(140, LICENSE + " once more")] * 6                              # repeated rows are one document
    rows += [(None, LICENSE), (None, None), (150, ""), (151, "\n"), (152, "\n" * 5), (153, LICENSE + "\n" + LICENSE)]
    return rows


@pytest.mark.parametrize("hot_rows", [10_000, 3])
def test_lines_equal_plain_code(spark, hot_rows):
    rows = line_rows()
    assert own_lines(documents(spark, rows), hot_rows=hot_rows) == plain_lines(rows)


def test_lines_of_odd_tables(spark):
    docs = odd_documents(spark).withColumn("at", F.lit(1)).withColumn("gone", F.lit(1)).withColumn("doc", F.lit("x"))
    assert own_lines(docs) == plain_lines(pairs(docs))
    assert own_lines(docs, min_docs=2, min_chars=1) == plain_lines(pairs(docs), 2, 1)
    assert lines.drop_shared_lines(empty_documents(spark)).count() == 0


def test_a_long_document_loses_all_its_lines(spark):
    many = "\n".join(f"{LICENSE} number {k}" for k in range(20000))
    rows = [(i, many) for i in range(6)]
    got = own_lines(documents(spark, rows))
    assert [(n, d) for _, n, d, _ in got] == [(20000, 20000)] * 5 + [(20000, 0)]


def test_a_line_of_half_of_all_rows_meets_no_task_alone(spark):
    """On its way to the positions the hot line joins by broadcast."""
    rows = [(i, f"{LICENSE}\nown line number {i} of a document, long enough to count") for i in range(400)]
    out = lines.drop_shared_lines(documents(spark, rows), hot_rows=100)
    assert out.agg(F.sum("n_dropped")).first()[0] == 399


# ranked search

def plain_terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def plain_search(docs, items, k=20):
    found = [(i, plain_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    out = []
    for item, text in set(items):
        ranked = []
        for i, w in found:
            tf = Counter(w)
            m = 75 + (25 * len(w) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
                    for t in plain_terms(text) if tf[t])
            if s > 0:
                ranked.append((-s, i is None, i or 0))
        out += [(str(item), r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


def own_search(docs, items, k=20, segment_bytes=8 << 20, **options):
    index, n = ranking.build_index(docs, segment_bytes=segment_bytes)
    return sorted(((str(r.item), r["rank"], r.id, r.score) for r in ranking.search(index, n, items, k=k, **options).collect()), key=str)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_search_equals_plain_code(spark):
    rng = random.Random(5)
    rows = [(d, prose(d, rng.randrange(0, 90), 60 if d % 3 else 900)) for d in range(500)]
    rows += [(600 + d, rows[7][1]) for d in range(60)]  # ties beyond the twentieth
    rng.shuffle(rows)
    items = [(i, prose(5000 + i, rng.choice([1, 4, 12, 40]), 900)) for i in range(25)]
    items += [(30, "word7 WORD7 word7 word8"), (31, None), (32, "unheard of"), (33, rows[7][1]), (33, "word1"), (33, "word1"), (None, "word2 word2")]
    docs, asked = documents(spark, rows).repartition(3), bench(spark, items)
    expect = plain_search(rows, items)
    assert own_search(docs, asked) == expect
    # many small segments, many batches of items
    assert own_search(docs, asked, segment_bytes=2000, batch_bytes=2000) == expect
    assert own_search(docs, asked, k=3, segment_bytes=2000) == plain_search(rows, items, 3)


def test_search_of_odd_tables(spark):
    docs = odd_documents(spark).withColumn("rank", F.lit("x")).withColumn("query", F.lit("x"))
    items = [(1, "word1 word2 Word3"), (2, ""), (3, "日本語 ß one")]
    asked = bench(spark, items).withColumn("id", F.lit("x")).withColumn("score", F.lit("x"))
    assert own_search(docs, asked) == plain_search(pairs(docs), items)
    assert own_search(empty_documents(spark), asked) == []
    assert own_search(docs, asked.limit(0)) == []


def test_variable_bytes_return():
    v = np.concatenate([np.arange(300), [127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 1 << 28, 1 << 40, (1 << 55) + 3]]).astype(np.int64)
    data, at = ranking.pack(v)
    assert (ranking.unpack(data) == v).all() and at[-1] == len(data)
    assert len(ranking.unpack(ranking.pack(np.zeros(0, np.int64))[0])) == 0


def test_bounds_spare_blocks(monkeypatch):
    """A rare term decides: most blocks of the frequent lists stay closed, and
    the result is that of adding up everything."""
    rng = random.Random(9)
    texts = [" ".join(["common"] * rng.randrange(1, 4) + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 60))]) for _ in range(20000)]
    for d in range(0, 20000, 900):
        texts[d] += " rare"
    n_terms = sum(len(t.split()) for t in texts)
    names = ["ids", "factors", "terms", "df", "bounds", "last", "peak", "place", "data"]
    seg = ranking.Segment(dict(zip(names, ranking.segment(np.arange(20000), pa.array(texts), 20000, n_terms))))
    words = next(ranking.terms(pa.array(["common rare w1 w2 w3"])))[2]
    found = seg.find(words.hash)
    df = seg.df[found]
    weights = np.array([ranking.weight(20000, int(x)) for x in df])
    bounds = weights * np.array([seg.peak[seg.first[t]:seg.first[t + 1]].max() for t in found])
    opened, plain = [], ranking.Segment.open

    def counting(self, term, blocks=None):
        doc, part = plain(self, term, blocks)
        opened.append(len(doc))
        return doc, part

    monkeypatch.setattr(ranking.Segment, "open", counting)
    heap = ranking.Heap(5)
    ranking.search_segment(seg, found, weights, bounds, heap)
    assert sum(opened) < df.sum() / 5
    total = np.zeros(20000, np.int64)
    for t, w in zip(found, weights):
        doc, part = plain(seg, t)
        total[doc] += w * part
    best = np.lexsort((np.arange(20000), -total))[:5]
    assert heap.id.tolist() == best.tolist() and heap.score.tolist() == total[best].tolist()


# importance resampling

def plain_features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(rows, target, percent=25, buckets=10000):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(crc(f) for _, t in rows for f in plain_features(t)[1])
    t = Counter(crc(f) for x in target for f in plain_features(x)[1])
    s_all, t_all = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for i, text in rows:
        w, f = plain_features(text)
        weight = sum(gain(crc(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted((tuple(r) + (drawn.get(id(r)),) for r in out), key=str)


def own_resample(docs, target, **options):
    return sorted(((r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"])
                   for r in importance.resample(docs, target, **options).collect()), key=str)


def test_resampling_equals_plain_code(spark):
    rng = random.Random(3)
    rows = [(d, prose(d, rng.randrange(0, 200), 300) + (" École ÀÉ Straße" if d % 4 == 0 else "")) for d in range(300)]
    target = [prose(9000 + d, 40, 100) for d in range(20)] + [None, ""]
    docs = documents(spark, rows).repartition(4)
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    assert own_resample(docs, asked) == plain_resample(rows, target)
    assert own_resample(docs, asked, percent=100, buckets=7) == plain_resample(rows, target, 100, 7)


def test_resampling_of_odd_tables(spark):
    docs = odd_documents(spark).withColumn("rank", F.lit("x")).withColumn("weight", F.lit("x")).withColumn("row", F.lit("x"))
    target = docs.select("text", F.lit(1).alias("bucket"))
    rows = [(i, t) for i, t in pairs(docs)]
    got, expect = own_resample(docs, target, percent=100), plain_resample(rows, [t for _, t in rows], 100)
    # of rows with equal score and id any one comes first
    assert [r[:5] for r in got] == [r[:5] for r in expect]
    assert sorted(r[5] for r in got if r[5]) == sorted(r[5] for r in expect if r[5]) == list(range(1, sum(r[1] >= 20 for r in got) + 1))
    assert own_resample(empty_documents(spark), target) == []
    assert {r[3] for r in own_resample(docs.limit(3), target.limit(0)) if r[2]} != set()


def test_crc_matrices_equal_zlib():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    size = np.concatenate([rng.integers(0, 40, 800), [1000, 1000, 1001, 0, 4000]])
    start = np.array([rng.integers(0, 5001 - n) for n in size])
    for cells in (1 << 22, 64):
        got = importance.crcs(data, start, size, cells)
        assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, size)]


def test_rank_is_exact_over_partitions(spark):
    rows = spark.range(20000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("s"), "id").repartition(7)
    got = importance.ranked(rows, [F.desc("s"), F.asc("id")]).collect()
    expect = sorted(((r.s, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.s, r.id) for r in sorted(got, key=lambda r: r["rank"])] == expect
    assert sorted(r["rank"] for r in got) == list(range(1, 20001))
