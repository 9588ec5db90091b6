"""Near-duplicates by ProbMinHash, banding and exact verification.

Shingles of five words (lower case, ASCII punctuation apart) weigh as often as
they occur. Every shingle is a Poisson process with its weight as rate; each
arrival strikes one of ``M`` registers, and a register keeps the shingle of its
earliest arrival. All shingles advance by one arrival a round, and one whose
time exceeds the latest register of its text is done (early termination). Two
texts agree in a register with the probability Jaccard similarity J_P, which
does not change when all weights of a text grow alike.

Registers form bands; texts that agree in a band share a bucket. Links are
pairs of different texts in one bucket whose exact J_P is ``threshold`` or more
(a pair at 0.8 shares no bucket with probability 4e-5). Classes are the
connected components of the links. Equal texts are one node; buckets of the
same nodes are one bucket. The pairs of a bucket are never emitted: buckets are
verified exactly inside tasks, and a task returns only a spanning forest of the
links it found.

A bucket of more than ``TILE`` nodes is first verified against ``PIVOTS`` of its
nodes, in chunks, and the components of these links are taken. What is left of
any bucket are the pairs of different components: its main component (that of
most nodes) is not compared with itself. Main component and rest are cut into
chunks; every pair of chunks with a side in the rest is a tile and a task call of
its own, so no call holds more than two chunks (about 2 x ``TILE`` texts) of a
large bucket. A bucket of n nodes of which r are outside the main component costs
about n x (``PIVOTS`` + r) comparisons: linear for copies of one text, and
quadratic only where the nodes of a bucket are not each other's near copies.
Smaller buckets go with the buckets of the same least node (at most ``BANDS``),
so that their shingles travel once.

Defined results: a null text counts as empty; texts without words link only to
equal texts; fewer than five words are one shingle; equal rows share a class;
the class id is the least id of the class (null only if it has no other id).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rollcall.operators.ranks import salted_join

from .arrays import BASE, MASK, PUNCT, STEP, U, Words, chunks, mix, powers, utf8
from .components import components
from .storage import ship, shuffle_partitions, small_batches, stage

ROWS, BANDS = 5, 26
M = ROWS * BANDS
SHINGLE, TILE, PIVOTS = 5, 1024, 8
#: Rows of a bucket or class from which its joins are salted.
HOT = 100_000
#: Tile entries a task at most, about; a task takes its tiles one after another.
TASK_ENTRIES = 64 * TILE


def shingles(column):
    """Yields (lo, hi, document, hash, weight): distinct shingles by document."""
    data, off = utf8(pc.utf8_lower(column))
    for lo, hi in chunks(off, 1 << 18):
        w = Words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], PUNCT)
        at, h = w.runs(SHINGLE, short=True)
        doc = w.doc[at]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[:len(h)]
        first = np.flatnonzero(new)
        yield lo, hi, doc[first], h[first], np.diff(np.append(first, len(h)))


def registers(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x M: the winning shingle of each register (0: the text has none)."""
    least, won = np.full(n * M, np.inf), np.zeros(n * M, U)
    rate, time, t = weight.astype(float), np.zeros(len(h)), 0
    while len(h):
        t += 1
        v = mix(h + U(t * BASE & MASK))
        time = time - np.log(((v >> U(32)).astype(float) + 0.5) * 2.0 ** -32) / rate
        cell = doc * M + (((v & U(0xFFFFFFFF)) * U(M)) >> U(32)).astype(np.int64)
        np.minimum.at(least, cell, time)
        first = time == least[cell]
        won[cell[first]] = h[first]
        live = time < least.reshape(n, M).max(axis=1)[doc]
        doc, h, rate, time = doc[live], h[live], rate[live], time[live]
    return won.reshape(n, M)


def _sketch(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            bands = []
            for lo, hi, doc, h, weight in shingles(part["text"]):
                won = registers(doc, h, weight, hi - lo)
                band = (won.reshape(-1, BANDS, ROWS) * powers(STEP, ROWS)).sum(axis=2, dtype=U)
                band = mix(band + np.arange(1, BANDS + 1, dtype=U) * U(0xA24BAED4963EE407)).view(np.int64)
                has = np.bincount(doc, minlength=hi - lo) > 0
                bands += [b.tolist() if f else [] for b, f in zip(band, has)]
            yield pa.RecordBatch.from_arrays([part["key"], part["id"], pa.array(bands, pa.list_(pa.int64()))],
                                             ["key", "id", "bands"])


def similarity(h1, c1, h2, c2) -> float:
    """Exact probability Jaccard of two sorted weighted sets."""
    if not len(h1) or not len(h2):
        return float(len(h1) == len(h2))
    _, a, b = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(a):
        return 0.0
    only1, only2 = c1.sum() - c1[a].sum(), c2.sum() - c2[b].sum()
    x, y = c1[a].astype(float), c2[b].astype(float)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    above = np.append(np.cumsum(x[order][::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(y[order]))
    at = np.searchsorted(r, ratio, "left")
    return float((1 / ((only1 + above[at]) / x + (only2 + below[at]) / y)).sum())


def _pack(h: np.ndarray, weight: np.ndarray) -> bytes:
    """Shingles as sorted 40-bit numbers, then their weights unless all are 1."""
    body = (h >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return len(h).to_bytes(4, "little") + body + (b"" if (weight == 1).all() else weight.astype("<u4").tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    h = np.zeros((n, 8), np.uint8)
    h[:, :5] = np.frombuffer(blob, np.uint8, n * 5, 4).reshape(n, 5)
    rest = np.frombuffer(blob, "<u4", offset=4 + 5 * n)
    return h.view("<u8").ravel(), rest.astype(np.int64) if len(rest) else np.ones(n, np.int64)


def _packed(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            out = []
            for lo, hi, doc, h, weight in shingles(part["text"]):
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                out += [_pack(h[a:b], weight[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(out, pa.binary())], ["node", "set"])


def spanning_links(sets: list, rows: np.ndarray, others: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (index pairs) that join everything ``rows`` x ``others`` joins: a
    spanning forest of all pairs whose exact similarity is the threshold or more.
    ``rows`` may be ``others``."""
    near = threshold - 1e-9
    flat = np.concatenate([sets[i][0] for i in others])
    owner = np.repeat(np.arange(len(others)), [len(sets[i][0]) for i in others])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    weight = np.concatenate([sets[i][1] for i in others])[order].astype(float)
    total = np.array([sets[i][1].sum() for i in others], float)
    size = np.array([len(sets[i][0]) for i in others], float)
    even = np.array([(sets[i][1] == sets[i][1][:1]).all() for i in others])
    group, links = np.arange(len(sets)), []
    for i in rows:
        h, w = sets[i]
        lo, hi = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.append(0, np.cumsum(n))[:-1], n)
        who = owner[at]
        common = np.bincount(who, minlength=len(others))
        ok = common / (len(h) + size - common) >= near
        flat_weights = (w == w[:1]).all()
        if not (flat_weights and even.all()):
            # J_P is at most the common share of either weight
            bound = np.minimum(np.bincount(who, np.repeat(w, n), minlength=len(others)) / w.sum(),
                               np.bincount(who, weight[at], minlength=len(others)) / total)
            odd = ~even | (not flat_weights)
            ok = np.where(odd, bound >= near, ok)
        for j in np.flatnonzero(ok):
            k = others[j]
            if group[k] == group[i] or k == i:
                continue
            if (flat_weights and even[j]) or similarity(h, w, *sets[k]) >= near:
                group[group == group[k]] = group[i]
                links.append((int(i), int(k)))
    return links


def _links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        sets = [_unpack(x.as_py()) for x in table["set"]]
        tiles: dict[tuple, list] = {}
        for i, entries in enumerate(table["tiles"].to_pylist()):
            for e in entries:
                tiles.setdefault((e["b"], e["i"], e["j"]), ([], []))[e["c"] != e["i"]].append(i)
        found = set()
        for (_, i, j), (own, other) in sorted(tiles.items()):
            own, other = np.array(own, int), np.array(other if i != j else own, int)
            if len(own) and len(other) and len(own) + len(other) > 1:
                # only this tile's sets, so that groups start apart
                index, at = np.unique(np.concatenate([own, other]), return_inverse=True)
                for a, b in spanning_links([sets[x] for x in index], at[:len(own)], at[len(own):], threshold):
                    found.add((nodes[index[a]], nodes[index[b]]))
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _own_call(*of):
    """Number of a call that holds one tile only (negative)."""
    return F.xxhash64(*of).bitwiseOR(F.lit(-1 << 63).cast("long"))


def _stars(large: DataFrame) -> DataFrame:
    """(g, node, tiles) of rows (b, n, node) of the large buckets: every chunk of
    a bucket with the bucket's pivots, each a call of its own. A pivot is the node
    nearest to a fixed number by exclusive or, so it is a plain minimum."""
    q = F.ceil(F.col("n") / TILE).cast("int")
    member = large.select("node", "b", F.pmod(F.xxhash64("node", "b"), q).cast("int").alias("j"))
    member = member.withColumn("c", F.col("j"))
    at = [F.lit((BASE * k & MASK) >> 1) for k in range(1, PIVOTS + 1)]
    least = [F.min(F.col("node").bitwiseXOR(x)).bitwiseXOR(x) for x in at]
    pivot = large.groupBy("b", "n").agg(F.array(*least).alias("pivots")) \
        .select("b", F.explode(F.array_distinct("pivots")).alias("node"), q.alias("q")) \
        .select("node", "b", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(-1).alias("c"))
    return member.union(pivot.select(*member.columns)) \
        .select("node", _own_call("b", "j").alias("g"), F.struct("b", F.lit(-1).alias("i"), "j", "c").alias("e")) \
        .groupBy("g", "node").agg(F.collect_list("e").alias("tiles"))


def _unsettled(inside: DataFrame, known: DataFrame) -> DataFrame:
    """(b, n, m, node, r, main) of the buckets whose nodes lie in several of the
    ``known`` components; ``r`` counts the nodes outside the main one."""
    placed = stage(inside.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "dup-placed")
    per = placed.groupBy("b", "component").agg(F.count(F.lit(1)).alias("k")) \
        .groupBy("b").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("all"))
    per = stage(per.select("b", F.col("top.component").alias("top"), (F.col("all") - F.col("top.k")).alias("r"), "all"), "dup-main")
    return salted_join(placed, per, ["b"], "all", HOT).where("r > 0") \
        .select("b", "n", "m", "node", "r", (F.col("component") == F.col("top")).alias("main"))


def _tiles(left: DataFrame, groups: int) -> DataFrame:
    """(g, node, tiles) of rows (b, n, m, node, r, main): what a task call ``g``
    gets. Buckets of one tile share ``groups`` calls by their least node; every
    tile of a larger bucket is a call of its own, so a call holds two chunks at
    most, whatever the bucket. Chunks of the rest come before those of the main
    component, and no tile is made of two of the latter."""
    one, main = F.col("n") <= TILE, F.col("main")
    rest = F.when(one, 1).otherwise(F.ceil(F.col("r") / TILE)).cast("int")
    mains = F.when(one, 0).otherwise(F.ceil((F.col("n") - F.col("r")) / TILE)).cast("int")
    h, i, j = F.xxhash64("node", "b"), F.least("c", "o"), F.greatest("c", "o")
    return left.withColumn("c", F.when(main & ~one, rest + F.pmod(h, mains)).otherwise(F.pmod(h, rest)).cast("int")) \
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.when(main, rest).otherwise(rest + mains) - 1))) \
        .select("node", F.when(one, F.pmod(F.xxhash64("m"), F.lit(groups))).otherwise(_own_call("b", i, j)).alias("g"),
                F.struct("b", i.alias("i"), j.alias("j"), "c").alias("e")) \
        .groupBy("g", "node").agg(F.collect_list("e").alias("tiles"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    group_rows: int = 4000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, key, class_id, class_size, first) of every row of ``docs``; ``key``
    is the md5 of its text, ``class_size`` counts rows, ``first`` marks the row
    (or equal rows) of the least id."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    sketches = rows.mapInArrow(_sketch, "key binary, id long, bands array<long>")
    nodes = stage(sketches.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
                  .withColumn("node", F.monotonically_increasing_id()), "dup-nodes")

    band = nodes.select("node", F.explode("bands").alias("b"))
    shared = band.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x")) \
        .where("n > 1").groupBy("n", "m", "x").agg(F.min("b").alias("b"))
    inside = stage(band.join(shared, "b").select("b", "n", "m", "node"), "dup-buckets")
    n_rows, in_large = inside.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > TILE, 1))).first()
    parts = max(shuffle_partitions(spark), math.ceil(n_rows / group_rows), 1)

    used = inside.select("node").distinct().join(nodes.select("node", "rep", F.col("key").alias("key_")), "node")
    used = stage(used, "dup-used")
    small = used.count() * 48 <= broadcast_bytes
    sets = rows.join(F.broadcast(used) if small else used, (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("rep"))) \
        .select("node", "text").mapInArrow(_packed, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))

    def verified(tiles: DataFrame, entries: int) -> DataFrame:
        dealt, tasks = tiles.join(sets, "node"), math.ceil(entries / TASK_ENTRIES)
        if tasks > parts:
            dealt = dealt.repartition(tasks, "g")
        return dealt.groupBy("g").applyInArrow(_links(threshold), "a long, b long")

    if in_large:  # otherwise no bucket has pivots, and all are left whole
        sets = stage(sets, "dup-sets")
        stars = stage(verified(_stars(inside.where(F.col("n") > TILE)), in_large), "dup-stars")
        left = stage(_unsettled(inside, components(stars)), "dup-left")
        fan = F.ceil(F.col("r") / TILE) + F.when(F.col("main"), 0).otherwise(F.ceil((F.col("n") - F.col("r")) / TILE))
        entries = left.agg(F.sum(F.when(F.col("n") > TILE, fan).otherwise(1))).first()[0] or 0
        links = verified(_tiles(left, parts * 8), entries).union(stars)
    else:
        links = verified(_tiles(inside.withColumns({"r": F.col("n"), "main": F.lit(False)}), parts * 8), n_rows)
    classes = components(links)

    named = nodes.select("key", "rep", "copies", "node").join(classes, "node", "left") \
        .withColumn("root", F.coalesce("component", "node"))
    named = stage(named.select("key", "rep", "copies", "root"), "dup-named")
    per = stage(named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("least"), F.sum("copies").alias("class_size"),
                                          F.count(F.lit(1)).alias("n")), "dup-roots")
    named = stage(salted_join(named, per, ["root"], "n", HOT).select(
        F.col("key").alias("key_"), F.col("least.rep").alias("class_id"), "class_size", (F.col("key") == F.col("least.key")).alias("first")), "dup-classes")
    return rows.select("id", "key").join(named, F.col("key") == F.col("key_")).select(
        "id", "key", "class_id", "class_size", (F.col("first") & F.col("id").eqNullSafe(F.col("class_id"))).alias("first"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, that of the least id
    (of equal rows any one)."""
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = stage(found.where("first").select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct(), "dup-keep")
    key = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    left = docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (key == F.col("__key"))).select(*docs.columns, "__id", "__key")
    return left.dropDuplicates(["__id", "__key"]).drop("__id", "__key")
