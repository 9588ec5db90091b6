import hashlib
import random
import re

from llm_cases import SCHEMA, empty_documents, odd_documents, tied_documents
from rollcall.llm.substring import _pack, _unpack, remove_repeats


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < order(i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, df, window, **options):
    got = [(r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest(), r.removed)
           for r in remove_repeats(df, window=window, **options).collect()]
    assert sorted([g[:4] for g in got], key=str) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], window)
    for g in got:
        assert sum(s.end - s.first for s in g[4]) == g[2]
        assert all(a.end < b.first for a, b in zip(g[4], g[4][1:]))


def test_random_documents(spark):
    rng = random.Random(5)
    shared = [[f"s{p}_{i}" for i in range(30)] for p in range(4)]
    rows = []
    for d in rng.sample(range(1000), 80):
        w = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 60))]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(0, 10):]
        rows.append((d, rng.choice([" ", "  \n", "\t"]).join(w), "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    check(spark, df, 10)
    check(spark, df, 10, block_bytes=500, bucket_windows=50)


def test_odd_rows(spark):
    check(spark, odd_documents(spark), 20)
    check(spark, odd_documents(spark), 50, block_bytes=1000)
    assert remove_repeats(empty_documents(spark)).count() == 0


def test_one_id_of_many_rows_is_divided(spark):
    df = tied_documents(spark)
    for frame in (df, df.where("doc_id is null"), df.where("doc_id = 30")):
        check(spark, frame, 8, block_bytes=2000, bucket_windows=500)


def test_hot_passage(spark):
    """A passage in every document goes from all but the first."""
    passage = " ".join(f"p{i}" for i in range(50))
    df = spark.createDataFrame([(d, f"own{d} " + passage, "en", "s", 0) for d in range(300)], SCHEMA)
    got = {r.id: r.n_removed for r in remove_repeats(df, block_bytes=2000).collect()}
    assert got == {d: 50 * (d > 0) for d in range(300)}


def test_runs_round_trip():
    import numpy as np

    for n, top in ((1, 10), (5, 2**64 - 1), (1000, 2**63)):
        u = np.unique(np.random.default_rng(n).integers(0, top, n, dtype=np.uint64))
        assert (_unpack(_pack(u)) == u).all()
