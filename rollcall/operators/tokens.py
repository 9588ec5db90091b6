"""Token ids of texts by a public subword vocabulary, in Arrow batches.

The vocabulary file's path is a parameter; its bytes (a few megabytes at most,
checked) are broadcast, and each Python worker opens them once. By the file's
ending: ``.json`` (tokenizers), ``.tiktoken`` (ranks and a split pattern) and
``.model`` (sentencepiece). Special tokens' strings in a text are ordinary text.

Defined results: a null or empty text has no tokens.

A tokenizer's own result takes about a hundred bytes a token. So a batch is encoded
in slices of ``SLICE_CHARS`` characters (a longer text alone), and each slice's
result goes out, as plain numbers, before the next one is made.
"""

from __future__ import annotations

import base64
import functools
import os
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import col

MAX_BYTES = 64 << 20
SLICE_CHARS = 128 << 10
#: Splits a text before ranks apply, where the file names no rule of its own.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=4)
def _open(kind: str, raw: bytes, split: str):
    """(encode a list of texts, token of an id, text of ids)."""
    if kind == ".json":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(raw)
        t.encode_special_tokens = True
        return (lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]), t.id_to_token, \
            lambda ids: t.decode(ids, skip_special_tokens=False)
    if kind == ".tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        t = tiktoken.Encoding("given", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [t.encode_ordinary(x) for x in texts]), \
            lambda i: t.decode_single_token_bytes(i).decode("utf-8", "backslashreplace"), t.decode
    if kind == ".model":
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return (lambda texts: t.encode(texts, num_threads=1)), t.id_to_piece, t.decode
    raise ValueError(f"no tokenizer reads {kind!r} files")


def _slices(texts: pd.Series) -> Iterator[list[str]]:
    """A batch's texts in order, in lists of about ``SLICE_CHARS`` characters."""
    part, size = [], 0
    for x in texts:
        x = x or ""
        if part and size + len(x) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x) + 1
    if part:
        yield part


class Vocabulary:
    """A vocabulary file, opened for Spark columns."""

    def __init__(self, spark: SparkSession, path: str, split: str = SPLIT):
        if "://" in path:  # a store that only Spark reads
            raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        else:
            with open(path, "rb") as f:
                raw = f.read(MAX_BYTES + 1)
        if len(raw) > MAX_BYTES:
            raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
        self.kind, self.split = os.path.splitext(path)[1], split
        _open(self.kind, raw, split)  # an unreadable file fails here, not in a task
        self._raw = spark.sparkContext.broadcast(raw)

    def _opened(self) -> Callable:
        raw, kind, split = self._raw, self.kind, self.split
        return lambda: _open(kind, raw.value, split)

    def ids(self, text) -> Column:
        """The token ids (array<int>)."""
        opened = self._opened()

        @F.pandas_udf(ArrayType(IntegerType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = opened()[0]
            for s in batches:
                for part in _slices(s):
                    yield pd.Series([np.array(x, "int32") for x in encoder(part)], dtype=object)

        return encode(col(text).cast("string"))

    def head(self, text, k: int) -> Column:
        """``struct<n, ids, tokens>``: the number of tokens of the whole text, and
        the ids and pieces of the first ``k``."""
        opened = self._opened()
        shape = StructType([StructField("n", IntegerType()), StructField("ids", ArrayType(IntegerType())), StructField("tokens", ArrayType(StringType()))])

        @F.pandas_udf(shape)
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder, token, _ = opened()
            for s in batches:
                for part in _slices(s):
                    rows = [(len(x), list(x[:k])) for x in encoder(part)]
                    yield pd.DataFrame({"n": [n for n, _ in rows], "ids": [x for _, x in rows], "tokens": [[token(i) for i in x] for _, x in rows]})

        return encode(col(text).cast("string"))

    def tokens(self, ids) -> Column:
        """Ids as array<struct<id, token>> of the vocabulary's own pieces."""
        opened = self._opened()
        shape = ArrayType(StructType([StructField("id", IntegerType()), StructField("token", StringType())]))

        @F.pandas_udf(shape)
        def name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            token = opened()[1]
            for s in batches:
                yield pd.Series([[{"id": int(i), "token": token(int(i))} for i in x] for x in s], dtype=object)

        return name(col(ids))

    def text(self, ids) -> Column:
        """The text of token ids."""
        opened = self._opened()

        @F.pandas_udf(StringType())
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            decoder = opened()[2]
            for s in batches:
                yield pd.Series([decoder([int(i) for i in x]) for x in s], dtype=object)

        return decode(col(ids))

    def count(self, text) -> Column:
        """Number of tokens; for ``with_lengths`` and ``prepare_examples``. The ids
        stay in the Python worker, and several counts of a row share one."""
        opened = self._opened()

        @F.pandas_udf(IntegerType())
        def size(s: pd.Series) -> pd.Series:
            encoder = opened()[0]
            return pd.Series([len(x) for part in _slices(s) for x in encoder(part)], dtype="int32")

        return size(col(text).cast("string"))


def token_dump(df: DataFrame, text_col: str, vocabulary: Vocabulary, k: int = 50) -> DataFrame:
    """One row for each of the first ``k`` tokens: 0-based ``pos``, ``id``, ``token``,
    and how many tokens follow the last one shown (``more``)."""
    d = df.withColumn("_head", vocabulary.head(text_col, k))
    d = d.withColumn("more", F.greatest(F.col("_head.n") - k, F.lit(0)))
    d = d.withColumn("_pieces", F.arrays_zip(F.col("_head.ids").alias("id"), F.col("_head.tokens").alias("token")))
    return d.select(*df.columns, "more", F.posexplode("_pieces").alias("pos", "_t")).select(*df.columns, "pos", "_t.id", "_t.token", "more")
