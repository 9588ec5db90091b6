import random

import numpy as np
import pyarrow as pa

from llm_cases import SCHEMA, empty_documents, odd_documents, probability_jaccard, prose, shingle_counts
from rollcall.llm import neardup
from rollcall.llm.components import components


def brute(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_counts(t) for _, t in rows]
    for x in range(len(rows)):
        for y in range(x):
            same = (rows[x][1] or "") == (rows[y][1] or "")
            if same or (sets[x] and sets[y] and probability_jaccard(sets[x], sets[y]) >= threshold - 1e-9):
                parent[find(x)] = find(y)
    classes = {}
    for x in range(len(rows)):
        classes.setdefault(find(x), []).append(rows[x][0])
    return sorted((i, min((v for v in c if v is not None), default=None), len(c)) for c in classes.values() for i in c if i is not None)


def check(spark, df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(df).collect()
    assert sorted((r.id, r.class_id, r.class_size) for r in got if r.id is not None) == brute(rows)
    assert len(got) == len(rows)
    return got


def edited(text, rng, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def test_groups_of_copies(spark):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = prose(100 + g, rng.choice([8, 40, 150, 400]))
        rows += [(base if rng.random() < 0.2 else edited(base, rng, rng.choice([0.0, 0.01, 0.03, 0.06]))) for _ in range(rng.randrange(1, 12))]
    rows += ["x y z " * 40, "x y z " * 41, "x y z " * 3 + "q", "a b"]
    rng.shuffle(rows)
    check(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA))


def test_large_bucket_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = random.Random(4)
    base = prose(9, 200)
    rows = [(i, edited(base, rng, 0.02), "en", "s", 0) for i in range(90)]
    check(spark, spark.createDataFrame(rows, SCHEMA))


def test_calls_do_not_grow_with_the_bucket(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(neardup, "TILE", 16)
    monkeypatch.setattr(neardup, "TASK_ENTRIES", 512, raising=False)
    real = neardup._links
    largest, entries = [], []
    for n in (60, 240):
        log = tmp_path / str(n)
        log.mkdir()

        def counted(threshold, log=str(log)):
            links = real(threshold)

            def run(table):
                import uuid
                with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(table.num_rows))
                return links(table)
            return run

        monkeypatch.setattr(neardup, "_links", counted)
        rng = random.Random(4)
        base = prose(9, 200)
        check(spark, spark.createDataFrame([(i, edited(base, rng, 0.005), "en", "s", 0) for i in range(n)], SCHEMA))
        sizes = [int(f.read_text()) for f in log.iterdir()]
        largest.append(max(sizes))
        entries.append(sum(sizes))
    # a call holds two chunks of 16 or so, not the bucket
    assert largest[1] <= 4 * 16, largest
    # four times the copies of one text: far from sixteen times the work
    assert entries[1] <= 8 * entries[0], entries


def test_tiles_hold_every_open_pair_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    n, r = 90, 37
    rows = [(5, n, 0, x, r, x >= r) for x in range(n)] + [(6, 10, 3, x, 4, x >= 4) for x in range(10)]
    left = spark.createDataFrame(rows, "b long, n long, m long, node long, r long, main boolean")
    calls, seen = {}, {}
    for row in neardup._tiles(left, 4).collect():
        for e in row.tiles:
            calls.setdefault((e.b, row.g, e.i, e.j), []).append((row.node, e.c))
    assert all(len(v) <= 5 * 16 for v in calls.values())
    for (b, _, i, j), members in calls.items():
        own, other = [x for x, c in members if c == i], [x for x, c in members if c == j]
        for pair in {tuple(sorted((x, y))) for x in own for y in other if x != y}:
            seen[b, pair] = seen.get((b, pair), 0) + 1
    assert set(seen.values()) == {1}
    assert {p for b, p in seen if b == 5} == {(x, y) for x in range(r) for y in range(x + 1, n)}
    assert {p for b, p in seen if b == 6} == {(x, y) for x in range(10) for y in range(x + 1, 10)}


def test_pivots_leave_only_open_buckets(spark):
    rows = [(1, 4, 0, x) for x in range(4)] + [(2, 5, 0, x) for x in (0, 1, 7, 8, 9)]
    inside = spark.createDataFrame(rows, "b long, n long, m long, node long")
    known = spark.createDataFrame([(x, 0) for x in range(4)] + [(7, 7), (8, 7)], "node long, component long")
    got = {(x.b, x.node): (x.r, x.main) for x in neardup._unsettled(inside, known).collect()}
    assert {k[0] for k in got} == {2} and {v[0] for v in got.values()} == {3}
    assert sorted(k[1] for k, v in got.items() if v[1]) in ([0, 1], [7, 8])


def test_odd_rows(spark):
    df = odd_documents(spark)
    check(spark, df)
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # 1 stands for its copies; null text, empty text and the null row are equal; both rows of 9 that differ stay
    assert ids == sorted(map(str, [1, 3, 5, 6, 7, 9, 9, 12, 13, None]))
    assert neardup.near_duplicates(empty_documents(spark)).count() == 0
    assert neardup.deduplicated(empty_documents(spark)).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = random.Random(8)
    a = [f"w{rng.randrange(60)}" for _ in range(900)]
    b = a[:600] + [f"w{rng.randrange(60)}" for _ in range(300)]
    texts = pa.array([" ".join(a), " ".join(b), " ".join(a) + " " + " ".join(a)])
    (lo, hi, doc, h, w), = neardup.shingles(texts)
    won = neardup.registers(doc, h, w, 3)
    exact = probability_jaccard(shingle_counts(texts[0].as_py()), shingle_counts(texts[1].as_py()))
    assert abs((won[0] == won[1]).mean() - exact) < 0.13
    assert (won[0] == won[2]).mean() > 0.95  # weights that all double change almost nothing


def test_exact_similarity():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h1, h2 = (np.unique(rng.integers(0, 12, 8)) for _ in range(2))
        c1, c2 = rng.integers(1, 5, len(h1)), rng.integers(1, 5, len(h2))
        from collections import Counter

        expect = probability_jaccard(Counter(dict(zip(h1.tolist(), c1.tolist()))), Counter(dict(zip(h2.tolist(), c2.tolist()))))
        assert abs(neardup.similarity(h1, c1, h2, c2) - expect) < 1e-9


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
