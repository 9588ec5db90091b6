"""Marker scans and special-token handling on raw completion text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import col, count_occurrences

# --- fixed values: markers scanned in raw completions (marker, description) ---
SCAN_MARKERS = [
    ("<|start|>assistant<|channel|>analysis<|message|>", "FULL analysis open"),
    ("<|start|>assistant<|channel|>final<|message|>", "FULL final open"),
    ("<|channel|>analysis<|message|>", "PARTIAL analysis open"),
    ("<|channel|>final<|message|>", "PARTIAL final open"),
    ("<|start|>", "start token"),
    ("<|channel|>", "channel token"),
    ("<|message|>", "message token"),
    ("<|end|>", "end token"),
    ("<|return|>", "return token"),
    ("assistant", "word 'assistant'"),
    ("analysis", "word 'analysis'"),
    ("final", "word 'final'"),
    ("```sql", "SQL code fence"),
    ("```", "code fence"),
    ("SELECT", "SELECT keyword"),
    ("select", "select keyword"),
]
# Special tokens of the tokenizer: id -> content (all flagged special).
SPECIAL_TOKENS = [
    (199998, "<|startoftext|>"), (199999, "<|endoftext|>"), (200000, "<|reserved_200000|>"),
    (200001, "<|reserved_200001|>"), (200002, "<|return|>"), (200003, "<|constrain|>"),
    (200004, "<|reserved_200004|>"), (200005, "<|channel|>"), (200006, "<|start|>"),
    (200007, "<|end|>"), (200008, "<|message|>"), (200009, "<|reserved_200009|>"),
    (200010, "<|reserved_200010|>"), (200011, "<|reserved_200011|>"), (200012, "<|call|>"),
    (200013, "<|reserved_200013|>"), (200014, "<|reserved_200014|>"), (200015, "<|reserved_200015|>"),
    (200016, "<|reserved_200016|>"), (200017, "<|reserved_200017|>"), (200018, "<|endofprompt|>"),
]
BOS, EOS, PAD = "<|startoftext|>", "<|return|>", "<|reserved_200017|>"
# --- end fixed values -----------------------------------------------------------


def _jquote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch for ch in s)


SPECIAL_RE = "|".join(_jquote(t) for _, t in SPECIAL_TOKENS)


def marker_scan(df: DataFrame, text_col: str, id_col: str, markers=SCAN_MARKERS, ctx: int = 20) -> DataFrame:
    """One row per (completion, marker present): count, first 0-based
    position and ±ctx characters of context with newlines escaped.

    The marker list is fixed, so each row builds its marker structs in a
    projection and ``inline`` emits them (no join with a marker table)."""
    t = F.col(text_col)
    rows = []
    for m, desc in markers:
        pos = F.instr(t, m) - 1
        start = F.greatest(pos - ctx, F.lit(0))
        end = F.least(F.length(t), pos + len(m) + ctx)
        rows.append(F.struct(F.lit(m).alias("marker"), F.lit(desc).alias("description"),
                             count_occurrences(t, m).alias("count"), pos.alias("pos"),
                             F.replace(F.substr(t, start + 1, end - start), F.lit("\n"), F.lit("\\n")).alias("context")))
    return df.select(id_col, F.inline(F.array(*rows))).where(F.col("count") > 0)


def strip_special_tokens(text) -> Column:
    """Text as a decoder with ``skip_special_tokens`` returns it."""
    return F.regexp_replace(col(text), SPECIAL_RE, "")


def load_special_tokens(spark, path: str) -> DataFrame:
    """Token table from a tokenizer config JSON (``added_tokens_decoder``:
    id -> {content, special, lstrip, rstrip, normalized, single_word})."""
    tok = "struct<content:string,special:boolean,lstrip:boolean,rstrip:boolean,normalized:boolean,single_word:boolean>"
    raw = spark.read.option("multiLine", True).schema(f"added_tokens_decoder map<string,{tok}>").json(path)
    return raw.select(F.explode("added_tokens_decoder").alias("id", "t")).select(
        F.col("id").cast("int").alias("id"), "t.*")
