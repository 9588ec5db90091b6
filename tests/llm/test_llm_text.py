"""Fingerprints, personal data and chat formatting."""

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from llm_cases import SCHEMA, empty_documents, odd_documents, prose, tied_documents
from rollcall.llm import chat, fingerprint, pii
from rollcall.llm.blocks import BLOCK_ROWS, with_blocks
from rollcall.llm.storage import table


def test_fingerprint_estimates():
    rng = random.Random(2)
    for n in (60, 500, 3000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = [f"w{rng.randrange(500)}" for _ in range(n)]
            b = a[:int(n * share)] + [f"w{rng.randrange(500)}" for _ in range(n - int(n * share))]
            sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
            exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            sig, full = fingerprint.sketch(pa.array([" ".join(a), " ".join(b)]))
            assert abs(fingerprint.likeness(sig[:1], sig[1:], full[:1], full[1:])[0] - exact) < 0.12


def brute_edited(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_pairs(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, prose(i, rng.randrange(0, 80)) + "é" * (i % 3), "en", "s", 0) for i in rng.sample(range(5000), 120)], SCHEMA)
    for frame, size in ((df, 4 << 20), (df, 3000), (odd_documents(spark), 1000), (odd_documents(spark), 1 << 20)):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        got = fingerprint.edited_pairs(frame, block_bytes=size).collect()
        assert sorted(((r.id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute_edited(rows)
        by_text = {}
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for r, f in zip(rows, fingerprint.fingerprints(frame).collect()):
            assert by_text.setdefault(r[1] or "", f.fingerprint) == f.fingerprint
    assert fingerprint.edited_pairs(empty_documents(spark)).count() == 0


def test_one_id_of_many_rows_is_divided(spark):
    df, size = tied_documents(spark), 2000
    units, counted, _ = with_blocks(df, "doc_id", "text", size)
    assert counted and units.agg(F.sum("n")).first()[0] == df.count()
    assert units.groupBy("block", "part").agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0] < 5 * size
    got = fingerprint.edited_pairs(df, block_bytes=size)
    assert "n" not in got.columns
    expect = brute_edited([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(((r.id, r.n_chars, r.edited_sha256) for r in got.collect()), key=str) == expect
    whole = fingerprint.edited_pairs(df, block_bytes=1 << 20).select(got.columns)
    assert got.exceptAll(whole).count() == 0 == whole.exceptAll(got).count()
    nulls = df.where("doc_id is null")
    assert with_blocks(nulls, "doc_id", "text", size)[0].select("part").distinct().count() > 5
    assert sorted(((r.id, r.n_chars, r.edited_sha256) for r in fingerprint.edited_pairs(nulls, block_bytes=size).collect()), key=str) \
        == brute_edited([(r.doc_id, r.text) for r in nulls.collect()])


def test_short_texts_are_bounded_in_rows(spark):
    """Neither a block nor the working arrays hold more rows when the texts are short."""
    texts = pa.array([f"w{i % 7}" for i in range(4000)])
    fingerprint.sketch(texts[:600])
    tracemalloc.start()
    try:
        sig, full = fingerprint.sketch(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert full.all() and peak < sig.nbytes + (12 << 20)
    assert (sig[:600] == fingerprint.sketch(texts[:600])[0]).all() and (sig[7:] == sig[:-7]).all()
    df = spark.range(0, 40000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    blocks, _, _ = with_blocks(df, "doc_id", "text", 1 << 16)
    assert blocks.count() == 40000 and blocks.groupBy("block", "part").count().agg(F.max("count")).first()[0] < 2 * BLOCK_ROWS


def test_small_tables_start_no_python_worker(spark):
    made = table(spark, [(1, None, "a"), (2, 5, None)], "x int, y long, z string")
    assert made.dtypes == [("x", "int"), ("y", "bigint"), ("z", "string")]
    assert [tuple(r) for r in made.orderBy("x").collect()] == [(1, None, "a"), (2, 5, None)]
    assert "Scan ExistingRDD" not in made._jdf.queryExecution().toString()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def ok(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and (sum(map(int, d[::-1][::2])) + sum(sum(map(int, str(2 * int(c)))) for c in d[::-1][1::2])) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k in PATTERNS for m in re.finditer(PATTERNS[k], text) if ok(k, m.group())]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(6)
    pieces = ["a@b.co", "x.y+z@mail-1.example.com.", "@", "a@@b.c", "1.2.3.4", "0.00.255.256", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "+1 (234) 567-8901", "+1", "++12 345 678 90", "12", "é", " ", "\n", "-", ".", "4539578763621486", "007.1.1.1", "a@b", "1234.5.6.7"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    import time

    began = time.time()
    for c in ("a", "1", "+", "@", ".", "a@", "1.", "1 ", "+1"):
        text = c * (200_000 // len(c))
        list(pii.candidates(text, pii.base_spans(text)))
    assert time.time() - began < 20


def test_patterns_discover_unseen_identifiers(spark):
    rng = random.Random(9)
    rows = [(i, f"{prose(i, 20)} reach office line +1 {rng.randrange(200, 999)} {rng.randrange(200, 999)} {rng.randrange(1000, 9999)} today", "en", "s", 0) for i in range(60)]
    rows += [(100 + i, f"{prose(100 + i, 20)} reach office line 0{rng.randrange(10**8, 10**9)} today and build 20{rng.randrange(10**4, 10**5)} done", "en", "s", 0) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (4_000_000, 1):
        got = {r.id: r for r in pii.find_personal_data(df, block=block).collect()}
        texts = {r[0]: r[1] for r in rows}
        assert all(not got[i].added and len(got[i].base) == 1 for i in range(60))
        for i in range(100, 110):
            assert [(s.kind, texts[i][s.start:s.end][:1]) for s in got[i].added] == [("phone", "0")]
    masked = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert all("[PHONE] today" in t for t in masked.values())
    assert all("build 20" in masked[i] for i in range(100, 110))


def test_personal_data_odd_rows(spark):
    df = odd_documents(spark)
    got = pii.find_personal_data(df).withColumn("s", pii.spans_text("base")).collect()
    assert len(got) == df.count()
    assert {r.s for r in got} == {"", "email:0:6,ip:7:14,card:17:36,phone:37:54"}
    masked = pii.redacted(df)
    assert masked.columns == df.columns and masked.count() == df.count()
    assert [r.text for r in masked.where("doc_id = 13").collect()] == ["[EMAIL] [IP] x [CARD] [PHONE]"]
    assert masked.where("text is null").count() == 2
    assert pii.find_personal_data(empty_documents(spark)).count() == 0
    assert pii.merged([(0, 5, "a"), (3, 8, "b"), (8, 9, "c")]) == [(0, 8, "a"), (8, 9, "c")]


def brute_conversations(rows):
    convs = {}
    for c, t, r, x in set(rows):
        r, x = r or "unknown", x or ""
        if c is None:  # a turn without id stands alone
            convs[(r, x)] = [((False, 0), r, x)]
        else:
            convs.setdefault(c, []).append(((t is not None, t or 0), r, x))
    convs = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, v in convs.items():
        if any(w[:len(v)] == v and len(w) > len(v) for w in convs.values()):
            continue
        out.setdefault(v, []).append(c)
    return sorted(((min((c for c in cs if isinstance(c, int)), default=None), len(v), len(cs)) for v, cs in out.items()), key=str)


def test_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        base = rng.randrange(6)
        for t in range(rng.randrange(1, 6)):
            text = f"turn {t} of {base}" if rng.random() < 0.95 else f"other {c}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    rows += [(None, 0, "user", "alone"), (70, None, None, None), (70, 1, "user", "<|im_end|> x"), (70, 1, "user", "<|im_end|> x"), (71, 0, "user", "long " * 20000)]
    rows += [(72, 0, "user", f"turn 0 of {b}") for b in range(2)]
    rows += [(None, 1, "user", "alone"), (None, 1, "user", "turn 0 of 1"), (None, 2, "user", "other 3"), (None, 2, None, "<|im_end|> x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("id", "last", "inner", "turns", "t"):
        df = df.selectExpr("*", f"'x' AS {c}")
    got = chat.format_conversations(df).collect()
    assert sorted(((r.id, r.n_turns, r.n_copies) for r in got), key=str) == brute_conversations(rows)
    texts = {r.id: r.text for r in got}
    assert [r.text for r in got if r.id is None and "alone" in r.text] == ["<|im_start|>user\nalone<|im_end|>\n"]
    assert texts[70] == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n<| im_end|> x<|im_end|>\n"
    assert chat.format_conversations(spark.createDataFrame([], df.schema)).count() == 0
