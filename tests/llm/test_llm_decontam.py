import random
import re
from collections import Counter

from llm_cases import SCHEMA, empty_documents, odd_documents, prose, shingle_counts
from rollcall.llm import decontam

SPLIT = re.compile(r"[^\w]+|_+")


def tokens(text):
    return [w for w in SPLIT.split((text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for k, (_, text) in enumerate(docs):
        w, best = tokens(text), {}
        for i, it in items:
            iw = tokens(it)
            if not iw or not w:
                continue
            s = min(5, len(iw))
            own = shingle_counts(" ".join(iw), s, SPLIT)
            for x in range(max(1, len(w) - len(iw) + 1)):
                win = shingle_counts(" ".join(w[x:x + len(iw)]), s, SPLIT)
                sim = sum((win & own).values()) / sum((win | own).values())
                if sim >= 0.8:
                    best[i] = max(best.get(i, 0), sim)
        out[k] = sorted(best)
    return sorted((str(docs[k][0]), v) for k, v in out.items())


def check(spark, docs, bench):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = decontam.flagged(docs, bench).collect()
    assert sorted((str(r.id), list(r["items"])) for r in got) == brute(rows, [(r.item_id, r.text) for r in bench.collect()])
    assert all(r.contaminated == bool(r["items"]) and r.n_items == len(r["items"]) and (r.similarity >= 0.8) == r.contaminated for r in got)
    bad = {str(r.id) for r in got if r.contaminated}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in got if not r.contaminated)
    return bad


def test_planted_items(spark):
    rng = random.Random(7)
    items = [(i, prose(1000 + i, rng.choice([3, 5, 14, 30, 60]))) for i in range(30)] + [(30, None), (31, " "), (2, prose(1002, 20))]
    docs = []
    for d in range(150):
        w = prose(d, rng.randrange(0, 120)).split(" ")
        for _ in range(rng.randrange(0, 3)):
            it = (rng.choice(items)[1] or "").split(" ")
            if rng.random() < 0.5 and len(it) > 10:
                it[rng.randrange(len(it))] = "changed"
            if rng.random() < 0.3:
                it = [x.upper() for x in it]
            at = rng.randrange(len(w) + 1)
            w[at:at] = it
        docs.append((d, ", ".join(w) if rng.random() < 0.2 else " ".join(w), "en", "s", 0))
    assert check(spark, spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))


def test_portions_of_the_benchmark_give_the_same(spark):
    docs = spark.createDataFrame([(d, prose(d, 30) + " " + prose(500, 20), "en", "s", 0) for d in range(50)], SCHEMA)
    bench = spark.createDataFrame([(1, prose(500, 20))], "item_id long, text string")
    a, b = (decontam.flagged(docs, bench, broadcast_bytes=n).collect() for n in (32 << 20, 100))
    assert sorted(a) == sorted(b) and all(r.contaminated for r in a)


def test_parts_in_another_order(spark):
    """Halves and thirds of an item, swapped, without a shingle at the item's place."""
    item = prose(77, 80, 5000).split()
    around = [prose(78, 100, 5000), prose(79, 100, 5000)]
    orders = {0: item[40:] + item[:40], 1: item[60:] + item[20:60] + item[:20], 2: item[30:] + item[:30], 3: item[::-1], 4: item[5:] + item[:5]}
    docs = spark.createDataFrame([(d, " ".join([around[0], *w, around[1]]), "en", "s", 0) for d, w in orders.items()], SCHEMA)
    bad = check(spark, docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {"0", "2", "4"} <= bad and "3" not in bad


def edited(rng, w):
    """Changed, dropped, added, swapped and repeated words."""
    w = list(w)
    for _ in range(rng.randrange(0, 3)):
        i = rng.randrange(len(w))
        kind = rng.randrange(5)
        if kind == 0:
            w[i] = "changed"
        elif kind == 1:
            del w[i]
        elif kind == 2:
            w.insert(i, "added")
        elif kind == 3:
            w[i], w[-1] = w[-1], w[i]
        else:
            j = rng.randrange(1, 12)
            w[i:i + j] = [w[i]] * j
    return w


def test_edits_and_repeated_words_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(i, prose(3000 + i, rng.choice([9, 25, 49, 104]), 900 if i % 2 else 8)) for i in range(16)]
    items += [(100, "again " * 30), (101, "a b " * 25)]
    docs = []
    for d in range(220):
        it = edited(rng, rng.choice(items)[1].split())
        w = prose(d, 40, 900).split()
        at = rng.randrange(len(w))
        docs.append((d, " ".join(w[:at] + it + w[at:]), "en", "s", 0))
    bad = check(spark, spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert len(bad) > 100


def test_recall_at_the_threshold(spark):
    """Sets whose similarity is just 0.8: no fingerprint pair is lost (0.99 is demanded)."""
    rng = random.Random(5)
    for size in (9, 45, 100, 200):
        least = -(-size * 8 // 9)
        pairs = []
        for n in range(600):
            a = [rng.getrandbits(63) for _ in range(size)]
            b = a[:least] + [rng.getrandbits(63) for _ in range(size - least)]
            pairs.append((n, size, a, b))
        df = spark.createDataFrame(pairs, "n long, len int, a array<long>, b array<long>")
        left = decontam.simhash(df.select("n", "len", df.a.alias("pairs")), ["n", "len"])
        right = decontam.simhash(df.select(df.n.alias("m"), "len", df.b.alias("pairs")), ["m", "len"])
        found = decontam.near_fingerprints(left, right, "n", "m", decontam.RADIUS).where("n = m").count()
        assert found >= 0.99 * 600
        assert found == 600


def test_occurrences_are_a_set_with_the_weighted_similarity(spark):
    rng = random.Random(6)
    lists = [[rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(x, y) for x, y in zip(lists, lists[1:])], "a array<long>, b array<long>")
    got = df.select("a", "b", decontam.occurrences("a").alias("x"), decontam.occurrences("b").alias("y")).collect()
    for r in got:
        assert len(set(r.x)) == len(r.x) == len(r.a)
        assert len(set(r.x) & set(r.y)) == sum((Counter(r.a) & Counter(r.b)).values())


def test_windows_that_can_reach_the_threshold(spark):
    """Against all starts: none that could is missing, and few that could not are there."""
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        n, size, k = rng.randrange(1, 60), rng.randrange(1, 30), 5
        k = min(k, size)
        hits = sorted(x for x in range(max(n - k + 1, 0)) if rng.random() < rng.choice([0.3, 0.9, 0.97]))
        rows.append((n, size, k, hits))
    df = spark.createDataFrame(rows, "n int, len int, k int, hits array<int>")
    got = df.select("*", decontam.window_starts(df.hits, df.n, df.len, df.k, 0.8).alias("s")).collect()
    for r in got:
        own, of_item = min(r.n, r.len) - r.k + 1, r.len - r.k + 1
        could = {s for s in range(max(r.n - r.len, 0) + 1)
                 if own > 0 and (m := sum(s <= x < s + own for x in r.hits)) and m / (own + of_item - m) >= 0.8}
        assert could <= set(r.s) and len(set(r.s)) == len(r.s)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, prose(5, 70)), (None, prose(3, 60)), (2, "one two")], "item_id long, text string")
    got = decontam.flagged(docs, bench).collect()
    assert len(got) == docs.count()
    assert {str(r.id) for r in got if r.contaminated} >= {"None", "6", "9"}
    assert not any(r.contaminated for r in decontam.flagged(docs, bench.limit(0)).collect())
    assert decontam.flagged(empty_documents(spark), bench).count() == 0
    assert decontam.clean(empty_documents(spark), bench).count() == 0


def test_blocks_cover_the_radius(spark):
    """Any two fingerprints within the radius are found, by whatever bits they differ."""
    rng, n_words = random.Random(1), decontam.WORDS
    rows = []
    for n in range(200):
        a = rng.getrandbits(64 * n_words)
        b = a
        for bit in rng.sample(range(64 * n_words), decontam.RADIUS + n % 2):
            b ^= 1 << bit
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((n, 30, *(signed(x >> (64 * w) & ((1 << 64) - 1)) for x in (a, b) for w in range(n_words))))
    names = [f"{x}{w} long" for x in "ab" for w in range(n_words)]
    df = spark.createDataFrame(rows, "n long, len int, " + ", ".join(names))
    left = df.select("n", "len", *[df[f"a{w}"].alias(f"f{w}") for w in range(n_words)])
    right = df.select(df.n.alias("m"), "len", *[df[f"b{w}"].alias(f"f{w}") for w in range(n_words)])
    found = {(r.n, r.m) for r in decontam.near_fingerprints(left, right, "n", "m", decontam.RADIUS).collect()}
    assert {(n, n) for n in range(0, 200, 2)} == {p for p in found if p[0] == p[1]}
