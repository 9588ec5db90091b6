"""Document fingerprints: one-permutation MinHash, densified, in packed low bits.

The distinct five-word shingles of a text are hashed once. The top bits choose
one of ``bins`` bins, each bin keeps its least hash, an empty bin takes the
value of the first full bin in its own fixed random order (optimal
densification), and only the low ``bits`` bits of each bin are stored, as hex.
Equal bins overstate likeness by chance agreement, which ``likeness`` corrects:
(share - 2**-bits) / (1 - 2**-bits), held within 0 and 1.

Defined results: fewer than five words form one shingle; a text without words
(null, empty, blanks) has the empty fingerprint, whose likeness is 1 to itself
and 0 to any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U, Words, chunks, utf8
from .blocks import UNIT, repeated, with_blocks
from .storage import ship, small_batches, table

BINS, BITS = 512, 4
SHINGLE = 5
#: Texts that the working arrays (some kilobytes a text) cover at once, however short they are.
DOCS = 256
EMPTY = U((1 << 64) - 1)
_ORDER: dict[int, np.ndarray] = {}


def _order(bins: int) -> np.ndarray:
    """Row b: the order in which bin b borrows from the others."""
    if bins not in _ORDER:
        rng = np.random.default_rng(bins)
        _ORDER[bins] = np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int32)
    return _ORDER[bins]


def sketch(column, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(documents x bins array of low bits, has words) of a string column."""
    data, off = utf8(column)
    shift = U(64 - (bins.bit_length() - 1))
    out, full = np.zeros((len(off) - 1, bins), np.uint8), np.zeros(len(off) - 1, bool)
    for lo, hi in chunks(off, 1 << 18, DOCS):
        w = Words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        at, h = w.runs(SHINGLE, short=True)
        doc = w.doc[at]
        least = np.full((hi - lo) * bins, EMPTY)
        np.minimum.at(least, doc * bins + (h >> shift).astype(np.int64), h)
        least = least.reshape(hi - lo, bins)
        have = least != EMPTY
        full[lo:hi] = have.any(axis=1)
        d, b = np.nonzero(~have & full[lo:hi, None])
        order, t = _order(bins), 0
        while len(d):
            take = order[b, t]
            ok = have[d, take]
            least[d[ok], b[ok]] = least[d[ok], take[ok]]
            d, b, t = d[~ok], b[~ok], t + 1
        out[lo:hi] = (least & U((1 << bits) - 1)).astype(np.uint8)
    out[~full] = 0
    return out, full


def likeness(a: np.ndarray, b: np.ndarray, a_full, b_full, bits: int = BITS) -> np.ndarray:
    chance = 2.0 ** -bits
    share = (a == b).mean(axis=1)
    near = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_full & b_full, near, (~a_full & ~b_full).astype(float))


def packed(sig: np.ndarray, full: np.ndarray) -> list[str]:
    """Two bins of four bits a byte, as hex; empty for a text without words."""
    rows = (sig[:, 0::2] << 4) | sig[:, 1::2]
    return [r.tobytes().hex() if f else "" for r, f in zip(rows, full)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint (whole texts; no shuffle)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(packed(*sketch(part["text"])), pa.string())],
                                                 ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, fingerprint string")


def _pairs(table: pa.Table) -> pa.Table:
    ids, texts, ahead, times = (table[c].to_pylist() for c in ("id", "text", "ahead", "n"))
    texts = [t or "" for t in texts]
    place = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    own, after = [i for i in place if not ahead[i]], next(i for i in place if ahead[i])
    follow = [*(texts[i] for i in own[1:]), texts[after]]
    # a row that stands for several: all but the last are followed by an equal text
    rows = [(ids[i], texts[i], t, k) for i, t in zip(own, follow)
            for t, k in ([(texts[i], times[i] - 1)] if times[i] > 1 else []) + [(t, 1)]]
    ids, texts, follow, times = (list(x) for x in zip(*rows))
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, follow)]
    sig, full = sketch(pa.array([*texts, follow[-1]], pa.large_string()))
    sig_e, full_e = sketch(pa.array(edited, pa.large_string()))
    return pa.table({
        "id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited],
        "fingerprint": pa.array(packed(sig[:-1], full[:-1]), pa.string()),
        "edited_fingerprint": pa.array(packed(sig_e, full_e), pa.string()),
        "near_edited": pa.array(likeness(sig[:-1], sig_e, full[:-1], full_e)),
        "near_next": pa.array(likeness(sig[:-1], sig[1:], full[:-1], full[1:])),
        "n": pa.array(times, pa.int64()),
    })


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness; the
    next document is that of the next id (equal ids: by text; null last; the
    last is followed by the first).

    Blocks are id ranges, a repeated or null id of many rows is cut into ranges
    of the text; the first row of a block also goes to the block before it, so
    every block is handled alone. The block starts on the driver are 24 bytes a
    block."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    df, counted, _ = with_blocks(docs, id_col, text_col, block_bytes)
    starts = sorted((r.block, r.part, r.at) for r in df.groupBy(*UNIT).agg(F.min("id").alias("at")).collect())
    shape = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not starts:
        return spark.createDataFrame([], shape)
    before = [(*unit, *starts[i - 1][:2]) for i, unit in enumerate(starts)]
    edge = F.broadcast(table(spark, before, "block int, part int, at long, to_block int, to_part int"))
    own = F.struct("block", "part", F.lit(False).alias("ahead"))
    back = F.struct(F.col("to_block").alias("block"), F.col("to_part").alias("part"), F.lit(True).alias("ahead"))
    leads = F.coalesce("leads", F.col("id").eqNullSafe(F.col("at")))
    rows = df.join(edge, UNIT).select("id", "text", "n", F.explode(F.when(leads, F.array(own, back)).otherwise(F.array(own))).alias("to"))
    out = rows.select("id", "text", "n", "to.block", "to.part", "to.ahead").groupBy(*UNIT).applyInArrow(_pairs, shape + ", n long")
    return repeated(out) if counted else out.drop("n")
