"""Exact substring removal by Rabin-Karp hashes of every fixed-length window.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Each block of documents
(a range of the id) hashes every window of ``window`` words and sends each
distinct hash once, in sorted runs that are packed as differences, to the hash's
bucket. A bucket says, for each hash of each block, whether an earlier block
has it; the answers (one bit a hash) return to the blocks, which remove the
words of repeated windows as merged maximal intervals. A window that fills a
third of the corpus is sent once per block, so no key is hot. A block of one
repeated (or null) id may come in parts, which do not count as earlier for each
other.

Two different windows are taken for equal with probability 2**-64 a pair.

Defined results: null or empty text, no words and no removal; fewer words than
``window``, no removal; rows with equal id do not remove each other's words;
a null id orders after all others.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import U, Words, chunks, utf8
from .blocks import UNIT, repeated, with_blocks
from .storage import ship, shuffle_partitions

LAST = np.iinfo(np.int64).max


def _pack(run: np.ndarray) -> bytes:
    """Sorted hashes as their first value and differences of one byte width."""
    step = np.diff(run, prepend=run[:1])
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    body = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(run[0]).to_bytes(8, "little") + body.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(body), 8), np.uint8)
    step[:, :width] = body
    return np.cumsum(step.view("<u8").ravel(), dtype=U) + U(int.from_bytes(blob[1:9], "little"))


def _order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The block's rows by id (null last), and the ids."""
    ids = np.asarray(table["id"].fill_null(LAST).to_numpy(), np.int64)
    by = np.argsort(ids, kind="stable")
    return table.take(pa.array(by)), ids[by]


def _windows(table: pa.Table, window: int):
    """Yields (lo, hi, words, first word of each window, hash) per chunk."""
    data, off = utf8(table["text"])
    for lo, hi in chunks(off):
        w = Words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        at, h = w.runs(window)
        yield lo, hi, w, at, h


def _send(window: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        block, part = table["block"][0].as_py(), table["part"][0].as_py()
        hashes = [h for *_, h in _windows(table, window)]
        u = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U)
        edge = np.searchsorted(u, np.arange(1 << bits, dtype=U) << U(64 - bits)) if bits else np.zeros(1, int)
        edge = np.append(edge, len(u))
        full = np.flatnonzero(np.diff(edge))
        return pa.table({"block": pa.array(np.full(len(full), block), pa.int32()),
                         "part": pa.array(np.full(len(full), part), pa.int32()),
                         "bucket": pa.array(full, pa.int32()),
                         "run": pa.array([_pack(u[edge[b]:edge[b + 1]]) for b in full], pa.binary())})
    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each block's run: one bit a hash, set if an earlier block has it."""
    table = table.sort_by("block")
    block = table["block"].to_numpy()
    runs = [_unpack(x.as_py()) for x in table["run"]]
    size = np.array([len(r) for r in runs])
    h = np.concatenate(runs)
    by = np.argsort(h, kind="stable")
    s, own = h[by], np.repeat(block, size)[by]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    least = np.repeat(own[start], np.diff(np.append(start, len(s))))  # a hash's first block
    seen = np.zeros(len(h), bool)
    seen[by] = own > least
    edge = np.append(0, np.cumsum(size))
    return pa.table({"block": pa.array(block, pa.int32()), "part": table["part"], "bucket": table["bucket"],
                     "seen": pa.array([np.packbits(seen[a:b]).tobytes() for a, b in zip(edge, edge[1:])], pa.binary()),
                     "n": pa.array(size, pa.int64())})


def _remove(window: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, ids = _order(table)
        rank = np.unique(ids, return_inverse=True)[1]
        parts = list(_windows(table, window))
        out = {"id": table["id"], "n": table["n"], "n_words": [], "n_removed": [], "kept": [], "removed": []}
        every = np.concatenate([p[4] for p in parts]) if parts else np.zeros(0, U)
        own = np.concatenate([rank[p[0] + p[2].doc[p[3]]] for p in parts]) if parts else np.zeros(0, int)
        u, first, which = np.unique(every, return_index=True, return_inverse=True)
        answers = answers.sort_by("bucket")
        seen = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8))[:n.as_py()] for b, n in zip(answers["seen"], answers["n"])]
        seen = np.concatenate(seen).astype(bool) if seen else np.zeros(0, bool)
        if len(seen) != len(u):
            raise RuntimeError("answers do not match the block's windows")
        drop, done = (seen[which] | (own[first][which] < own)) if len(u) else np.zeros(0, bool), 0
        for lo, hi, w, at, h in parts:
            bad = at[drop[done:done + len(at)]]
            done += len(at)
            edge = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(edge, bad, 1)
            np.add.at(edge, bad + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.append(0, np.cumsum(gone))
            for d in range(hi - lo):
                a, b = w.first[d], w.first[d + 1]
                words = w.data[w.start[a]:w.end[b - 1]].tobytes().split() if b > a else []
                k = int(total[b] - total[a])
                spans = []
                if k:
                    mask = gone[a:b]
                    flip = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans = [{"first": int(x), "end": int(y)} for x, y in zip(flip[::2], flip[1::2])]
                    words = list(compress(words, (~mask).tolist()))
                out["n_words"].append(int(b - a))
                out["n_removed"].append(k)
                out["kept"].append(b" ".join(words).decode("utf-8"))
                out["removed"].append(spans)
        return pa.table({"id": out["id"], "n": out["n"], "n_words": pa.array(out["n_words"], pa.int64()),
                         "n_removed": pa.array(out["n_removed"], pa.int64()),
                         "kept": pa.array(out["kept"], pa.string()),
                         "removed": pa.array(out["removed"], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))})
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                   block_bytes: int = 4 << 20, bucket_windows: int = 2_000_000) -> DataFrame:
    """Per document: id, n_words, n_removed, ``kept`` (remaining words joined by
    one space) and ``removed`` (maximal word intervals). A word goes if a window
    over it also starts in a document with a smaller id."""
    spark = docs.sparkSession
    ship(spark)
    df, counted, total = with_blocks(docs, id_col, text_col, block_bytes)
    bits = max(total // 6 // bucket_windows, shuffle_partitions(spark) if total > 1 << 20 else 1, 1).bit_length()
    df = df.drop("leads")
    runs = df.groupBy(*UNIT).applyInArrow(_send(window, bits), "block int, part int, bucket int, run binary")
    seen = runs.groupBy("bucket").applyInArrow(_answer, "block int, part int, bucket int, seen binary, n long")
    out = df.groupBy(*UNIT).cogroup(seen.groupBy(*UNIT)).applyInArrow(
        _remove(window), "id long, n long, n_words long, n_removed long, kept string, removed array<struct<first: long, end: long>>")
    return repeated(out) if counted else out.drop("n")
