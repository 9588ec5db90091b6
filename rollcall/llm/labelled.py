"""Labelled rows: the split that contracts fix, and bounded training samples."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 0 modulo 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, keys: DataFrame, bound, id_col: str = "doc_id", text_col: str = "text"):
    """Whole texts of at most ``bound`` labelled ids of each class, chosen by
    hash of the id: (Arrow column of texts, labels, classes). ``bound`` is one
    number, or one for each class.

    ``keys`` has columns id and label (null in either: not labelled). At most
    that many ids are broadcast, and twice as many texts collected."""
    keys = keys.where("id is not null and label is not null").select("id", "label")
    classes = sorted(r.label for r in keys.select("label").distinct().collect())
    if not classes:
        return pa.chunked_array([[]], pa.string()), [], []
    most = {c: bound[c] if isinstance(bound, dict) else bound for c in classes}
    chosen = reduce(DataFrame.union, [
        keys.where(F.col("label") == F.lit(c)).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most[c])
        for c in classes])
    got = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .join(F.broadcast(chosen), "id").limit(2 * sum(most.values())).select("id", "text", "label").toArrow()
    got = got.sort_by([("id", "ascending"), ("text", "ascending")])  # the same model whatever the order of arrival
    return got["text"], got["label"].to_pylist(), classes
