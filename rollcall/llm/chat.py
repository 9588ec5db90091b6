"""Chat formatting after a collapse of cumulative snapshots.

A log often holds one conversation several times, each time longer. Every turn
gets the rolling hash of all turns up to it. A conversation whose last hash is
an inner hash of a longer one is a snapshot of it and goes (anti-join against
the distinct inner hashes); of equal conversations the least id stays. The
maximal ones are rendered.

Hashes are 128-bit. Inner hashes are made distinct before the join, so a first
turn that most conversations share is one row.

Defined results: identical rows of one conversation count once; turns order by
(turn, role, text), null first; a null role renders as ``unknown``, a null text
as empty; a turn without id is a conversation of its own (equal ones count once,
whatever their number); markers inside a text are
broken by a blank so that a text cannot open or close a turn.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import ship, stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SAFE_OPEN, SAFE_CLOSE = "<| im_start|>", "<| im_end|>"


def _rolling(batches):
    """Adds the rolling hash after each turn (inner) and after all (last)."""
    for batch in batches:
        inner, last = [], []
        for turns in batch["turns"].to_pylist():
            h, seen = b"", []
            for t in turns:
                d = hashlib.blake2b(h, digest_size=16)
                for part in (t["role"], t["text"]):
                    raw = part.encode("utf-8")
                    d.update(len(raw).to_bytes(8, "little") + raw)
                h = d.digest()
                seen.append(h)
            inner.append(seen[:-1])
            last.append(h)
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(inner, pa.list_(pa.binary())), pa.array(last, pa.binary()), batch["turns"]],
            ["id", "inner", "last", "turns"])


def maximal_conversations(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_copies, turns): conversations that no other one continues, each
    once; ``n_copies`` counts the equal ones."""
    spark = convs.sparkSession
    ship(spark)
    has_id = F.col(id_col).cast("long").isNotNull()
    turn = F.struct(F.when(has_id, F.col(turn_col).cast("long")).alias("turn"),
                    F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = convs.select(F.col(id_col).cast("long").alias("id"), turn.alias("t")) \
        .groupBy("id", F.when(F.col("id").isNull(), F.col("t")).alias("alone")) \
        .agg(F.array_sort(F.collect_set("t")).alias("turns")).drop("alone")
    hashed = stage(whole.mapInArrow(
        _rolling, "id long, inner array<binary>, last binary, turns array<struct<turn: long, role: string, text: string>>"), "chat")
    inner = hashed.select(F.explode("inner").alias("last")).distinct()
    # null orders after every id; the minimum skips it unless it is alone
    one = hashed.groupBy("last").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"))
    keep = one.join(inner, "last", "left_anti").withColumnRenamed("id", "kept").withColumnRenamed("last", "kept_last")
    return hashed.join(keep, (F.col("last") == F.col("kept_last")) & F.col("id").eqNullSafe(F.col("kept"))) \
        .select("id", "n_copies", "turns")


def render(turns: str = "turns"):
    """One text of all turns, in the im_start / im_end layout."""
    def safe(c):
        return F.replace(F.replace(c, F.lit(OPEN), F.lit(SAFE_OPEN)), F.lit(CLOSE), F.lit(SAFE_CLOSE))

    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(CLOSE + "\n"))), "")


def format_conversations(convs: DataFrame, **columns) -> DataFrame:
    """(id, n_turns, n_copies, text) of the maximal conversations."""
    return maximal_conversations(convs, **columns).select(
        "id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render().alias("text"))
