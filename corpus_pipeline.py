"""Corpus pipeline: five stages over ``documents``, each an operator of
``rollcall.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; between stages the documents are written to the shared folder and read
again. All but the last return the columns of ``documents``; the last adds each
document's rate in the mix.

Defined results: documents with a null text count as empty (quality judges them
as one empty line); an empty table stays empty; extra columns pass through,
whatever their names, but for the last stage's own (``n_tokens``, ``rate``,
``residual``, ``unsettled``, ``p_...``), which replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.llm.decontam import clean
from rollcall.llm.labelled import held_out
from rollcall.llm.mixing import mix
from rollcall.llm.neardup import deduplicated
from rollcall.llm.pii import redacted
from rollcall.llm.quality import quality
from rollcall.llm.storage import read, stage

KEEP_FROM = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (learnt outside the held-out fold) accepts."""
    labels = read(spark, sf_dir, "labels").where(~held_out())
    kept = [f"__{i}" for i in range(len(docs.columns))]  # the result may hold a name twice
    scored = quality(docs, labels, keep=tuple(docs.columns)).toDF("__id", "__score", *kept)
    return scored.where(F.col("__score") >= KEEP_FROM).select(*[F.col(k).alias(c) for k, c in zip(kept, docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked by kind; n_chars follows the text."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens, rate and domain posteriors."""
    rates = mix(docs, read(spark, sf_dir, "labels")).dropDuplicates(["id", "key"]) \
        .withColumnRenamed("id", "__id").withColumnRenamed("key", "__key")
    new = {c.lower() for c in rates.columns}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(rates, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (key == F.col("__key"))) \
        .drop("__id", "__key")


STAGES = [
    ("quality classifier", quality_filter),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("mixing", mix_domains),
]

#: A trained classifier and an iterative fit have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
