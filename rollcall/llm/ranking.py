"""Ranked lexical search with Block-Max MaxScore over compressed segments.

Terms are runs of letters, digits and all characters from U+0080, A-Z in lower
case. The index is a table of segments, each one row made from ``segment_bytes``
of text by the task that reads it: document ids and length factors, the sorted
term hashes, and for every term its postings (place and frequency as variable
bytes) in blocks of ``BLOCK``, with each block's last place and largest share.
All terms of all documents are indexed.

A search collects the items in batches of ``batch_bytes`` of terms (one scan of
the index a batch, whatever the number of items), sums the terms' document
frequencies over the segments, takes their global bounds, and sends the weighted
items to the index. A task keeps one heap an item over all its segments (a
shard):

* Lists are added from the largest global bound down; as soon as the lists that
  are left could not lift a document without any other term to the threshold,
  these are non-essential. The threshold is the ``k``-th best score so far.
* The documents of the essential lists are candidates. The block maxima of the
  non-essential lists, at the candidate's block, bound its score; candidates
  that stay under the threshold are dropped before any block is decompressed.
* For the others, list by list, only blocks that hold a candidate are opened,
  and candidates drop as the bound becomes exact.

Equal scores are never dropped against the threshold, so ties resolve by id.
The shards' heaps are merged by a ranked window. All scores are 64-bit integers.
Terms are compared by 64-bit hashes.

Defined results: a null or termless text is no document, matches nothing and
counts nowhere; an item without terms has no rows; every benchmark row is an
item of its own, equal rows once; rows with equal id rank as separate documents,
null ids after all others of that score; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .arrays import BETWEEN, LOWER, U, Words, chunks, utf8
from .storage import ship, stage

BLOCK, TOP = 64, 20
NO_ID = np.iinfo(np.int64).max
SEGMENT = "ids binary, factors binary, terms binary, df binary, bounds binary, last binary, peak binary, place binary, data binary"


def terms(column, hashes: bool = True):
    """Yields (lo, hi, words) of lower-cased texts."""
    data, off = utf8(column)
    for lo, hi in chunks(off, 1 << 22):
        yield lo, hi, Words(LOWER[data[off[lo]:off[hi]]], off[lo:hi + 1] - off[lo], BETWEEN, hashes)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes, seven bits each, and where every value begins."""
    size = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in range(1, 9))
    at = np.append(0, np.cumsum(size))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[at[has] + k] = ((values[has] >> (7 * k)) & 127).astype(np.uint8) | more
    return out, at


def unpack(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    start = np.append(0, end[:-1] + 1)[:len(end)]
    out = np.zeros(len(end), np.int64)
    for k in range(int((end - start).max(initial=-1)) + 1):
        has = np.flatnonzero(start + k <= end)
        out[has] |= (data[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def share(tf, factor):
    """A term's part of a document's score before its weight."""
    return (1000000000 * tf) // (1000 * tf + 12 * factor)


def segment(ids: np.ndarray, column, n_docs: int, n_terms: int) -> list[bytes] | None:
    """One row of the index, or nothing if no document has a term."""
    hashes, doc, count = [], [], []
    for lo, _, w in terms(column):
        hashes.append(w.hash)
        doc.append(w.doc + lo)
        count.append(w.count)
    hashes, doc, count = np.concatenate(hashes), np.concatenate(doc), np.concatenate(count)
    if not len(hashes):
        return None
    factor = 75 + (25 * count * n_docs) // n_terms
    order = np.argsort(hashes, kind="stable")  # by term, then by place
    hashes, doc = hashes[order], doc[order]
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
    tf = np.diff(np.append(first, len(hashes)))
    hashes, doc = hashes[first], doc[first]
    head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    df = np.diff(np.append(head, len(hashes)))
    inside = np.arange(len(doc)) - np.repeat(head, df)
    begin = np.flatnonzero(inside % BLOCK == 0)
    step = np.diff(doc, prepend=0)
    step[begin] = doc[begin]
    part = share(tf, factor[doc])
    flat = np.empty(2 * len(doc), np.int64)
    flat[::2], flat[1::2] = step, tf
    data, at = pack(flat)
    raw = lambda x, t: x.astype(t).tobytes()
    return [raw(ids, "<i8"), raw(factor, "<i8"), raw(hashes[head], "<u8"), raw(df, "<u4"), raw(np.maximum.reduceat(part, head), "<u4"),
            raw(doc[np.append(begin[1:], len(doc)) - 1], "<u4"), raw(np.maximum.reduceat(part, begin), "<u4"),
            raw(np.append(at[2 * begin], at[-1]), "<u4"), data.tobytes()]


def _indexer(n_docs: int, n_terms: int, segment_bytes: int):
    def run(batches):
        names = [f.split()[0] for f in SEGMENT.split(", ")]

        def flush(parts):
            table = pa.Table.from_batches(parts)
            ids = np.asarray(table["id"].fill_null(NO_ID).to_numpy(), np.int64)
            row = segment(ids, table["text"], n_docs, n_terms)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in row], names)

        have, size = [], 0
        for batch in batches:
            at = 0
            off = utf8(batch["text"])[1]
            while at < batch.num_rows:
                # as many rows as the segment still takes, one at least
                upto = int(np.searchsorted(off, off[at] + segment_bytes - size, "right")) - 1
                upto = min(max(upto, at + 1), batch.num_rows)
                have.append(batch.slice(at, upto - at))
                size += int(off[upto] - off[at])
                at = upto
                if size >= segment_bytes or at < batch.num_rows:
                    yield from flush(have)
                    have, size = [], 0
        if have:
            yield from flush(have)
    return run


def _measure(batches):
    docs = words = 0
    for batch in batches:
        for _, _, w in terms(batch["text"], hashes=False):
            docs += int((w.count > 0).sum())
            words += len(w.start)
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([words])], ["docs", "words"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """(table of segments, number of documents with a term)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_docs, n_terms = rows.select("text").mapInArrow(_measure, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    found = rows.mapInArrow(_indexer(n_docs or 0, max(n_terms or 0, 1), segment_bytes), SEGMENT)
    return stage(found, "search-index"), n_docs or 0


def _item_terms(batches):
    for batch in batches:
        h, n = [], []
        for lo, hi, w in terms(batch["text"]):
            for d in range(hi - lo):
                u, c = np.unique(w.hash[w.first[d]:w.first[d + 1]], return_counts=True)
                h.append(u.view(np.int64))
                n.append(c)
        yield pa.RecordBatch.from_arrays([batch["item"], batch["key"], pa.array(h, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64()))],
                                         ["item", "key", "terms", "repeats"])


def _frequencies(wanted):
    def run(batches):
        want = wanted.value
        df, bound = np.zeros(len(want), np.int64), np.zeros(len(want), np.int64)
        for batch in batches:
            for t, d, b in zip(batch["terms"], batch["df"], batch["bounds"]):
                own = np.frombuffer(t.as_py(), "<u8")
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                has = own[at] == want
                df[has] += np.frombuffer(d.as_py(), "<u4")[at[has]]
                bound[has] = np.maximum(bound[has], np.frombuffer(b.as_py(), "<u4")[at[has]])
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has]), pa.array(bound[has])], ["at", "df", "bound"])
    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """A row of the index, opened."""

    def __init__(self, row: dict):
        self.ids, self.factors = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["factors"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u8")
        df = np.frombuffer(row["df"], "<u4").astype(np.int64)
        self.df, self.first = df, np.append(0, np.cumsum(-(-df // BLOCK)))
        self.last, self.peak = np.frombuffer(row["last"], "<u4"), np.frombuffer(row["peak"], "<u4").astype(np.int64)
        self.place, self.data = np.frombuffer(row["place"], "<u4"), np.frombuffer(row["data"], np.uint8)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each term in this segment, -1 where it has none."""
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def open(self, term: int, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, shares) of a list, or of some of its blocks (ascending, by number in the list)."""
        a, b = self.first[term], self.first[term + 1]
        if blocks is None or len(blocks) == b - a:
            blocks, raw = np.arange(b - a), self.data[self.place[a]:self.place[b]]
        else:
            raw = np.concatenate([self.data[self.place[a + x]:self.place[a + x + 1]] for x in blocks])
        flat = unpack(raw)
        step, tf = flat[::2], flat[1::2]
        size = np.full(len(blocks), BLOCK)
        if len(blocks) and blocks[-1] == b - a - 1:
            size[-1] = self.df[term] - BLOCK * (b - a - 1)
        head = np.append(0, np.cumsum(size))[:-1]
        total = np.cumsum(step)
        doc = total - np.repeat(total[head] - step[head], size)
        return doc, share(tf, self.factors[doc])


class Heap:
    """The best ``k`` (score, id) pairs; ties by the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.score, score), np.append(self.id, ids)
        best = np.lexsort((ids, -score))[:self.k]
        self.score, self.id = score[best], ids[best]


def search_segment(seg: Segment, found: np.ndarray, weights: np.ndarray, bounds: np.ndarray, heap: Heap) -> None:
    """Adds the segment's best documents to the heap. ``found``: the item's terms
    in the segment (-1: absent); ``weights`` x share sums to a score; ``bounds``:
    each term's largest part of a score anywhere."""
    here = np.flatnonzero((found >= 0) & (weights > 0))
    here = here[np.argsort(-bounds[here], kind="stable")]
    rest = np.append(np.cumsum(bounds[here][::-1])[::-1], 0)  # what lists from here on can add
    total = np.zeros(len(seg.ids), np.int64)
    floor, essential = heap.threshold, 0
    while essential < len(here) and rest[essential] >= floor:
        t = here[essential]
        doc, part = seg.open(found[t])
        total[doc] += weights[t] * part
        essential += 1
        if len(total) >= heap.k and essential < len(here):
            floor = max(floor, int(np.partition(total, -heap.k)[-heap.k]))
    doc = np.flatnonzero(total)
    doc = doc[total[doc] + rest[essential] >= floor]
    if not len(doc):
        return
    score, others, block, most = total[doc], here[essential:], [], []
    for t in others:
        a, b = seg.first[found[t]], seg.first[found[t] + 1]
        at = np.searchsorted(seg.last[a:b], doc)
        block.append(at)
        most.append(np.where(at < b - a, weights[t] * seg.peak[np.minimum(a + at, b - 1)], 0))
    if len(others):
        block, most = np.stack(block), np.stack(most)
        bound = score + most.sum(axis=0)
        for i, t in enumerate(others):
            stay = bound >= floor
            doc, score, bound, block, most = doc[stay], score[stay], bound[stay], block[:, stay], most[:, stay]
            if not len(doc):
                return
            need = np.unique(block[i][most[i] > 0])
            if len(need):
                held, part = seg.open(found[t], need)
                at = np.minimum(np.searchsorted(held, doc), len(held) - 1)
                own = np.where(held[at] == doc, weights[t] * part[at], 0)
                score, bound = score + own, bound + own
            bound = bound - most[i]
    stay = score >= floor
    heap.add(score[stay], seg.ids[doc[stay]])


def _searcher(queries, k: int):
    def run(batches):
        items = queries.value
        heaps = [Heap(k) for _ in items]
        every = np.unique(np.concatenate([t for _, t, _, _ in items])) if items else np.zeros(0, U)
        within = [np.searchsorted(every, t) for _, t, _, _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch.slice(i, 1).to_pylist()[0])
                found = seg.find(every)
                for heap, at, (_, _, weights, bounds) in zip(heaps, within, items):
                    search_segment(seg, found[at], weights, bounds, heap)
        n = [len(h.score) for h in heaps]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([q for q, *_ in items], n).astype(np.int64)),
             pa.array(np.concatenate([h.score for h in heaps]) if heaps else np.zeros(0, np.int64)),
             pa.array([None if x == NO_ID else x for h in heaps for x in h.id.tolist()], pa.int64())], ["query", "score", "id"])
    return run


def search(index: DataFrame, n_docs: int, items: DataFrame, item_id: str = "item_id", item_text: str = "text", k: int = TOP,
           batch_bytes: int = 8 << 20) -> DataFrame:
    """(item, rank, id, score): the best ``k`` documents of every item."""
    spark = index.sparkSession
    ship(spark)
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    asked = stage(asked.withColumn("key", F.xxhash64("item", "text"))
                  .mapInArrow(_item_terms, "item long, key long, terms array<long>, repeats array<long>")
                  .where(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()), "search-items")
    size = asked.agg(F.sum(F.size("terms").cast("long") * 32)).first()[0] or 0
    batches = -(-size // batch_bytes)
    out = None
    for b in range(batches):  # each of about batch_bytes: the driver never holds more
        own = asked.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b).select("query", "terms", "repeats").toArrow()
        ask = [(q.as_py(), np.array(t.as_py(), np.int64).view(U), np.array(r.as_py(), np.int64))
               for q, t, r in zip(own["query"], own["terms"], own["repeats"])]
        want = np.unique(np.concatenate([t for _, t, _ in ask])) if ask else np.zeros(0, U)
        counted = index.select("terms", "df", "bounds") \
            .mapInArrow(_frequencies(spark.sparkContext.broadcast(want)), "at long, df long, bound long") \
            .groupBy("at").agg(F.sum("df").alias("df"), F.max("bound").alias("bound")).collect()  # one row a term of the batch
        weights, bounds = np.zeros(len(want), np.int64), np.zeros(len(want), np.int64)
        for r in counted:
            weights[r["at"]], bounds[r["at"]] = weight(n_docs, r.df), r.bound
        known = []
        for q, t, r in ask:
            at = np.searchsorted(want, t)
            known.append((q, t, r * weights[at], r * weights[at] * bounds[at]))
        got = index.mapInArrow(_searcher(spark.sparkContext.broadcast(known), k), "query long, score long, id long")
        out = got if out is None else out.union(got)
    if out is None:
        return spark.createDataFrame([], "item long, rank int, id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = out.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item"), "query").select("item", "rank", "id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Index and search in one call."""
    index, n_docs = build_index(docs, id_col, text_col)
    return search(index, n_docs, items, **options)
