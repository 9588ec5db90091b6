"""Removal of lines that many documents share.

Every document is split at line feeds. A line's key is the line without the
characters 0x20 and 0x09-0x0D at its ends, A-Z in lower case; keys of at least
``min_chars`` code points are hashed to 128 bits. The lines are exploded with
their positions, and the documents of each hash are counted. A key found in
``min_docs`` documents or more loses all its lines, except in the document of
the largest id that holds it. The remaining lines are joined again by position.

Only hashes travel: the texts are read again for the last step, where they join
the positions to drop, one row a document that loses lines. The count merges
before the shuffle. Lines on more than ``hot_rows`` places (or a 100,000th of
all places, if that is more; so at most 100,000 keys) are found by a broadcast,
so a line that a third of the corpus holds meets no task alone.

Defined results: a null or empty text is one empty line; rows with equal id are
one document (a null id is one that orders before all others); equal rows get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .storage import stage

BLANKS = " \t\n\x0b\x0c\r"
LEAST = -(1 << 63)


def line_keys(text: Column) -> Column:
    """The keys of all lines, in order."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lower, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def places(text: Column, min_chars: int) -> Column:
    """(position, 128-bit hash) of every line whose key is long enough."""
    found = F.transform(line_keys(text), lambda k, i: F.when(F.length(k) >= min_chars, F.struct(
        i.alias("at"), F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))))
    return F.filter(found, lambda x: x.isNotNull())


def without(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions ``gone``."""
    def join(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # the one-element array binds the lines once, not once for each position
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), join), F.lit(0))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5,
                      min_chars: int = 40, hot_rows: int = 10_000) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row; ``kept`` is the text that stays."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("id", F.lit(LEAST).cast("long"))).withColumn("key", F.xxhash64("text"))
    held = stage(rows.select("doc", "key", places(F.col("text"), min_chars).alias("p")).where(F.size("p") > 0), "line-places")
    line = held.select("doc", "key", F.explode("p").alias("p")).select("doc", "key", "p.*")
    shared = stage(line.groupBy("h", "g", "doc").agg(F.count(F.lit(1)).alias("n")).groupBy("h", "g").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.max("doc").alias("last"))
        .where(F.col("docs") >= min_docs), "line-shared")
    every = held.agg(F.sum(F.size("p").cast("long"))).first()[0] or 0
    is_hot = F.col("n") > max(hot_rows, every // 100_000)
    hot, cold = F.broadcast(shared.where(is_hot)), shared.where(~is_hot)
    hits = line.join(hot, ["h", "g"]).select("doc", "key", "at", "last") \
        .union(line.join(hot, ["h", "g"], "left_anti").join(cold, ["h", "g"]).select("doc", "key", "at", "last"))
    gone = stage(hits.where("doc != last").groupBy(F.col("doc").alias("doc_"), F.col("key").alias("key_"))
                 .agg(F.collect_set("at").alias("gone")), "line-gone")
    found = rows.join(gone, (F.col("doc") == F.col("doc_")) & (F.col("key") == F.col("key_")), "left")
    return found.select(
        "id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("gone"))).alias("kept"))
