"""Benchmark decontamination with SimHash windows.

A document leaks an item if one of its item-sized word windows has a weighted
Jaccard similarity of 0.8 or more to the item, over shingles of five words
(weight: how often a shingle occurs). Words are runs of letters and digits, in
lower case.

1. A window can only reach the threshold t if at least t / (1 + t) x (its
   shingles + the item's) of its shingles occur in the item, in whatever order.
   A scan looks up every shingle of every document among the benchmark's
   shingles and keeps, per document and item, the sorted places of the hits.
   Running over these, every start whose window could hold enough hits is a
   window; no other window can be accepted by the last step.
2. Every window gets a 256-bit SimHash of its (shingle, occurrence) pairs; the
   pairs are a set whose plain Jaccard equals the weighted one. Fingerprints of
   equal word count join the items' through a multi-index of ``BLOCKS`` blocks:
   two fingerprints within ``radius`` bits agree in some block up to
   radius / BLOCKS bits, and the items are entered under all these block values
   (11,152 rows an item, whatever the corpus; joined by shuffle).
3. Pairs within the radius are verified by exact counts of the pairs.

At similarity 0.8 fingerprints differ in 38.8 bits on average with a standard
deviation of 5.7, so the radius of 63 loses about one window in 80,000 there,
and fewer above.

Main path: DataFrame functions only. The benchmark's shingles are broadcast in
portions of at most ``broadcast_bytes``, with one scan of the documents each.

Defined results: a null or wordless text leaks nothing; items without words are
skipped; items of fewer than five words are one shingle, also of their window;
equal rows get equal results; a document shorter than the item is one window.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .storage import empty, stage

SHINGLE, RADIUS = 5, 63
#: 64-bit words of a fingerprint, its blocks, and the bits of a block.
WORDS, BLOCKS = 4, 16
BITS = 64 * WORDS // BLOCKS


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(ws: str, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    n = F.size(ws) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(
        *[F.element_at(ws, (i + j).cast("int")) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def occurrences(hashes: str) -> Column:
    """A set with one number for each element of a list: an element's first
    occurrence is itself, a later one a hash with its number."""
    def numbered(all_: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            nth = i + 1 - F.array_position(all_, x)
            return F.when(nth == 0, x).otherwise(F.xxhash64(x, nth))
        return F.transform(all_, pair)

    # the one-element array binds the sorted list once
    many = F.get(F.transform(F.array(F.array_sort(hashes)), numbered), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.col(hashes)).otherwise(many)


def simhash(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f0, f1, ...) of rows (keys, pairs): every bit is the majority of that
    bit over the set. Two bits share one sum, in its lower and upper half."""
    h = sets.select(*keys, F.explode("pairs").alias("__h0"))
    h = h.select("*", *[F.xxhash64(F.lit(w), F.col("__h0")).alias(f"__h{w}") for w in range(1, WORDS)])
    both = F.lit((1 << 32) + 1)
    sums = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[
        F.sum(F.shiftrightunsigned(f"__h{w}", b).bitwiseAND(both)).alias(f"__s{w}_{b}") for w in range(WORDS) for b in range(32)])

    def word(w: int) -> Column:
        """The bits of a word are apart, so their sum joins them; the highest one is negative."""
        pairs = F.transform(F.array(*[F.col(f"__s{w}_{b}") for b in range(32)]), lambda s, b: F.struct(
            (s.bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("__n")).alias("low"), (F.shiftrightunsigned(s, 32) * 2 > F.col("__n")).alias("high"), b.alias("b")))
        one = F.lit(1).cast("long")
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["low"], F.call_function("shiftleft", one, x["b"])).otherwise(F.lit(0).cast("long"))
                           + F.when(x["high"], F.call_function("shiftleft", one, x["b"] + 32)).otherwise(F.lit(0).cast("long")))

    return sums.select(*keys, *[word(w).alias(f"f{w}") for w in range(WORDS)])


def blocks(prefix: str) -> Column:
    """(number, bits) of the disjoint blocks of a fingerprint."""
    each = BLOCKS // WORDS
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(f"{prefix}{i // each}", BITS * (i % each))
                              .bitwiseAND(F.lit((1 << BITS) - 1)).alias("bits")) for i in range(BLOCKS)])


def distance(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in range(WORDS)])


def near_fingerprints(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius: int) -> DataFrame:
    """(left_key, right_key) of all fingerprints (key, len, f0, f1, ...) of equal
    length within ``radius`` bits, each pair once."""
    spark = left.sparkSession
    # every change of up to radius / BLOCKS bits of a block: one array, a scalar of the plan
    masks = spark.range(1 << BITS).where(F.bit_count("id") <= radius // BLOCKS).agg(F.array_sort(F.collect_list("id"))).scalar()
    f, g = [f"f{w}" for w in range(WORDS)], [f"g{w}" for w in range(WORDS)]
    a = left.select(left_key, "len", *f, F.explode(blocks("f")).alias("b")).select(left_key, "len", *f, "b.*")
    b = right.select(right_key, F.col("len").alias("len_"), *[F.col(x).alias(y) for x, y in zip(f, g)], F.explode(blocks("f")).alias("b"))
    b = b.withColumn("mask", F.explode(masks)).select(
        right_key, "len_", *g, F.col("b.no").alias("no_"), F.col("b.bits").bitwiseXOR(F.col("mask")).alias("bits_"))
    # the planner takes the rows before the masks for the size: never broadcast these
    return a.join(b.hint("merge"), (F.col("len") == F.col("len_")) & (F.col("no") == F.col("no_")) & (F.col("bits") == F.col("bits_"))) \
        .where(distance("f", "g") <= radius).select(left_key, right_key).distinct()


def window_starts(hits: Column, n_words: Column, item_words: Column, k: Column, threshold: float) -> Column:
    """Starts of all item-sized windows that could reach the threshold. ``hits``:
    the sorted places of the document's shingles that the item has.

    A window belongs to its first hit. It starts at most as many places before
    it as may miss, but behind the hit before, and the number of hits it needs
    must lie within its size from the first one on."""
    own, of_item = F.least(n_words, item_words) - k + 1, item_words - k + 1
    need = F.greatest(F.ceil((own + of_item) * (threshold / (1 + threshold)) - 1e-9).cast("int"), F.lit(1))
    last = F.greatest(n_words - item_words, F.lit(0))

    def from_hit(i: Column) -> Column:
        at = F.get(hits, i)
        before = F.coalesce(F.get(hits, i - 1), F.lit(-1))
        first, end = F.greatest(before + 1, at - (own - need), F.lit(0)), F.least(at, last)
        enough = F.coalesce(F.get(hits, i + need - 1) <= at + own - 1, F.lit(False))
        return F.when(enough & (first <= end), F.sequence(first, end)).otherwise(F.array().cast("array<int>"))

    some = F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - need), from_hit))
    return F.when(F.size(hits) < need, F.array().cast("array<int>")).otherwise(some)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", threshold: float = 0.8, radius: int = RADIUS, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, key, item, start, similarity): every leaking window, once for each
    different document text and id; ``key`` is the xxhash64 of the text."""
    spark = docs.sparkSession
    named = benchmark.select(F.col(item_id).cast("long").alias("item"), words(F.col(item_text)).alias("ws")).where("size(ws) > 0")
    named = stage(named.withColumn("own", F.md5(F.array_join("ws", " ").cast("binary"))), "leak-items")
    # items of equal words are one
    items = named.groupBy("own").agg(F.first("ws").alias("ws")).withColumn("len", F.size("ws")).withColumn("k", F.least(F.lit(SHINGLE), F.col("len")))
    items = stage(items.withColumn("copy", F.monotonically_increasing_id()), "leak-distinct-items")
    widths = sorted(r.k for r in items.select("k").distinct().collect())  # at most SHINGLE numbers
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), words(F.col(text_col)).alias("ws"))
    hit = empty(spark, "id long, key long, n int, copy long, at int")
    for k in widths:
        places = stage(items.where(F.col("k") == k).select("copy", F.explode(shingle_hashes("ws", k)).alias("sh")).distinct(), "leak-places")
        every = rows.select("id", "key", F.size("ws").alias("n"), F.posexplode(shingle_hashes("ws", k)).alias("at", "sh"))
        portions = math.ceil(places.count() * 24 / broadcast_bytes)
        for i in range(portions):
            some = places.where(F.pmod(F.xxhash64("sh"), F.lit(portions)) == i) if portions > 1 else places
            hit = hit.union(every.join(F.broadcast(some), "sh").select("id", "key", "n", "copy", "at"))
    # one document's places in one item
    held = hit.groupBy("id", "key", "n", "copy").agg(F.array_sort(F.collect_set("at")).alias("hits"))
    held = held.join(items.select("copy", "len", "k"), "copy")
    found = stage(held.select("id", "key", "len", "k", F.explode(window_starts(
        F.col("hits"), F.col("n"), F.col("len"), F.col("k"), threshold)).alias("start")).distinct(), "leak-windows")
    # the words of the documents that have windows
    hit_docs = found.select("id", "key").distinct()
    ws = rows.join(hit_docs, (rows["id"].eqNullSafe(hit_docs["id"])) & (rows["key"] == hit_docs["key"]), "left_semi") \
        .dropDuplicates(["id", "key"])
    at = found.alias("f").join(ws.alias("d"), F.col("f.id").eqNullSafe(F.col("d.id")) & (F.col("f.key") == F.col("d.key")))
    cut = F.slice("d.ws", F.col("start") + 1, F.col("len"))
    windows = stage(at.select("f.id", "f.key", "f.start", "f.len", "f.k", cut.alias("ws"))
                    .withColumn("w", F.unhex(F.md5(F.array_join("ws", " ").cast("binary")))), "leak-texts")

    def sets(df: DataFrame, *keep: str) -> DataFrame:
        hashed = F.coalesce(*[F.when(F.col("k") == k, F.when(F.size("ws") >= k, shingle_hashes("ws", k))
                                     .otherwise(F.array(F.xxhash64(F.array_join("ws", " "))))) for k in widths]) \
            if widths else F.array().cast("array<bigint>")
        return df.withColumn("sh", hashed).select(*keep, "len", occurrences("sh").alias("pairs"))

    # windows of equal words (a passage that many documents share) are one from here on
    one = stage(sets(windows.groupBy("w", "len", "k").agg(F.first("ws").alias("ws")).withColumn("win", F.concat("w", F.col("len").cast("string").cast("binary"))),
                     "win"), "leak-sets")
    own = stage(sets(items, "copy"), "leak-item-sets")
    near = near_fingerprints(simhash(one, ["win", "len"]), simhash(own, ["copy", "len"]), "win", "copy", radius)
    # exact: the pairs both have over the pairs either has
    both = near.join(one.select("win", "pairs"), "win").join(own.select("copy", F.col("pairs").alias("pairs_")), "copy")
    m = F.size(F.array_intersect("pairs", "pairs_"))
    sure = both.select("win", "copy", (m / (F.size("pairs") + F.size("pairs_") - m)).alias("similarity")).where(F.col("similarity") >= threshold)
    where = windows.select(F.concat("w", F.col("len").cast("string").cast("binary")).alias("win"), "id", "key", "start")
    return sure.join(items.select("copy", "own"), "copy").join(named.select("own", "item").distinct(), "own").join(where, "win") \
        .select("id", "key", "item", "start", "similarity")


def flagged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, contaminated, n_items, items, similarity) of every row of ``docs``."""
    found = leaks(docs, benchmark, id_col, text_col, **options)
    per = stage(found.groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("similarity").alias("similarity")), "leaks")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"))
    per = per.select(F.col("id").alias("id_"), F.col("key").alias("key_"), "items", "similarity")
    return rows.join(per, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left").select(
        "id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    bad = stage(leaks(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct(), "leaks")
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")
