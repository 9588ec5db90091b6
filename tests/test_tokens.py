"""Token ids against the vocabularies' own libraries, and against plain merging."""

import base64
import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from rollcall.operators import prepare as P
from rollcall.operators import tokens as T

FOLDER = "/opt/tokenizers/"
TEXTS = ["Hello, world!", "", None, "SELECT a, b FROM t WHERE c = 'x''y'", "  two  blanks\n\nand lines\t", "été ß 日本語 🙂", "<|endoftext|> is text", "a" * 5000]


def reference(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(FOLDER + name)
        t.encode_special_tokens = True
        return lambda x: t.encode(x, add_special_tokens=False).ids
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=FOLDER + name).encode
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FOLDER + name, "rb"))}
    return tiktoken.Encoding("x", pat_str=T.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_ids_equal_the_library(spark, name):
    v, encode = T.Vocabulary(spark, FOLDER + name), reference(name)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").withColumn("ids", v.ids("text"))
    rows = df.withColumn("back", v.text("ids")).withColumn("n", v.count("text")).orderBy("i").collect()
    for r in rows:
        assert r.ids == list(encode(r.text or "")) and r.n == len(r.ids)
        if name.startswith("byte"):
            assert r.back == (r.text or "")  # bytes survive the round trip


def test_a_batch_is_encoded_in_slices(spark, monkeypatch):
    """No more than a slice's texts are encoded at once, and the whole text counts."""
    sizes = []
    texts = pd.Series(["abc " * 5000, None, "", "x" * (3 * T.SLICE_CHARS)] + ["word " * 2000] * 50)
    parts = list(T._slices(texts))
    assert [x for p in parts for x in p] == [x or "" for x in texts] and len(parts) > 4
    assert all(len(p) == 1 or sum(map(len, p)) <= T.SLICE_CHARS for p in parts)
    monkeypatch.setattr(T, "_open", lambda *a: (lambda part: sizes.append(sum(map(len, part))) or [[7] * len(x) for x in part], str, None))
    v = object.__new__(T.Vocabulary)
    v.kind, v.split, v._raw = "", "", type("Raw", (), {"value": b""})()
    text = "word " * 2000
    for column, n in ((v.ids, 50), (v.count, 50), (lambda c: v.head(c, 3), 50)):
        sizes.clear()
        out = _run(column, pd.Series([text] * n))
        assert sum(sizes) == n * len(text) and max(sizes) <= T.SLICE_CHARS and len(out) == n


def _run(column, texts):
    """The Python function behind a column's UDF, over one batch."""
    made = []
    wrap = F.pandas_udf
    try:
        F.pandas_udf = lambda kind: lambda f: made.append(f) or wrap(kind)(f)
        column(F.lit("x"))
    finally:
        F.pandas_udf = wrap
    f = made[0]
    out = f(iter([texts])) if "batches" in f.__code__.co_varnames else f(texts)
    return out if isinstance(out, pd.Series) else pd.concat(list(out), ignore_index=True)


def test_head_counts_the_whole_text(spark):
    encode, v = reference("byte_bpe_50k.json"), T.Vocabulary(spark, FOLDER + "byte_bpe_50k.json")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").withColumn("h", v.head("text", 4)).withColumn("all", v.ids("text"))
    for r in df.collect():
        ids = encode(r.text or "")
        assert (r.h.n, r.h.ids, len(r.h.tokens)) == (len(ids), ids[:4], len(ids[:4])) and r["all"] == ids


def test_both_files_of_one_vocabulary_agree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    one, other = (T.Vocabulary(spark, FOLDER + n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    assert df.where(~one.ids("text").eqNullSafe(other.ids("text"))).count() == 0


def test_ids_equal_plain_merging(spark):
    """Words of ASCII letters: the lowest-ranked neighbouring pair merges until none is left."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FOLDER + "byte_bpe_50k.tiktoken", "rb"))}

    def merge(word):
        parts = [bytes([b]) for b in word.encode()]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    text = "the quick unbelievable tokenisations of zyzzyva antidisestablishmentarianism"
    expect = [i for w in re.findall(r" ?[a-z]+", text) for i in merge(w)]
    v = T.Vocabulary(spark, FOLDER + "byte_bpe_50k.json")
    assert spark.createDataFrame([(text,)], "text string").select(v.ids("text").alias("i")).first().i == expect


def test_dump_shows_the_first_tokens(spark):
    v = T.Vocabulary(spark, FOLDER + "byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "i int, text string")
    rows = T.token_dump(df, "text", v, k=3).orderBy("i", "pos").collect()
    assert [(r.i, r.pos, r.token, r.more) for r in rows] == [(1, 0, "one", 1), (1, 1, "Ġtwo", 1), (1, 2, "Ġthree", 1)]
    assert v.text(F.array(*[F.lit(r.id) for r in rows])) is not None
    assert T.token_dump(df.limit(0), "text", v).count() == 0


def test_vocabulary_counts_in_the_length_report(spark):
    encode = reference("byte_bpe_50k.json")
    v = T.Vocabulary(spark, FOLDER + "byte_bpe_50k.json")
    schema = "messages array<struct<role: string, content: string, thinking: string>>"
    df = spark.createDataFrame([([("user", "question one?", None), ("assistant", "SELECT 1", "some thought")],), ([("user", "q", None)],)], schema)
    rows = P.with_lengths(df, count=v.count).orderBy("total_tokens").collect()
    assert [r.content_tokens for r in rows] == [0, len(encode("SELECT 1"))]
    assert rows[1].thinking_tokens == len(encode("some thought"))
    assert all(r.prompt_tokens == len(encode(r.prompt_text)) for r in rows)
    prepared = P.prepare_examples(df, count=v.count).collect()
    assert all(r.prompt_tokens == len(encode(r.prompt_text)) for r in prepared) and len(prepared) == 2


def test_queries_without_sql(spark):
    encode = reference("byte_bpe_50k.json")
    rows = E.queries()["token_ids"](spark, SF_SMALL).collect()
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()}
    expect = {(c, t, p, i) for (c, t), x in texts.items() for p, i in enumerate(encode(x or "")[:50])}
    assert {(r.conv_id, r.turn, r.pos, r.id) for r in rows} == expect and len(rows) == len(expect)
    stats = {r.series: r for r in E.queries()["token_id_stats"](spark, SF_SMALL).collect()}
    assert stats["sql"].n > 0 and stats["prompt"].max >= stats["prompt"].median


def test_unreadable_vocabularies_fail_early(spark, tmp_path):
    for name, body in (("x.json", json.dumps({})), ("x.bin", "")):
        (tmp_path / name).write_text(body)
        with pytest.raises(Exception):
            T.Vocabulary(spark, str(tmp_path / name))
