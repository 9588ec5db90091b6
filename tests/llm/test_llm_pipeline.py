import re

from llm_cases import odd_documents
from rollcall.llm.queries import ORACLES, QUERIES
from rollcall.llm.storage import BATCH_ROWS, empty, read, small_batches, stage

SF = "/root/testdata/sf0.001"


def test_names():
    names = {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES}
    assert names == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_stages_equal_their_operators(spark):
    """Every stage, against plain code over what its predecessor kept."""
    import corpus_pipeline as P
    from rollcall.llm import decontam, mixing, neardup, pii, quality

    docs = read(spark, SF, "documents")
    columns = docs.columns
    labels = read(spark, SF, "labels").where("crc32(cast(doc_id as string)) % 5 != 0")
    for k, (name, step) in enumerate(P.STAGES):
        out = stage(step(spark, docs, SF), f"test-{k}")
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()}
        if k == 0:
            good = {r.id for r in quality.quality(docs, labels).collect() if r.score >= 0.3}
            assert set(after) == good and 0 < len(good) < len(before)
        if k == 1:
            assert set(after) == {r.class_id for r in neardup.near_duplicates(docs).collect()}
        if k == 2:
            bad = {r.id for r in decontam.flagged(docs, read(spark, SF, "benchmark")).collect() if r.contaminated}
            assert set(after) == set(before) - bad
        if k == 3:
            assert set(after) == set(before)
            for i, r in before.items():
                text, done, own = "", 0, pii.merged((a, b, kind) for kind, a, b in pii.base_spans(r.text))
                for a, b, kind in own:
                    text, done = text + r.text[done:a] + f"[{kind.upper()}]", b
                assert after[i].text == text + r.text[done:] and after[i].n_chars == len(after[i].text)
        if k < 4:
            assert out.columns == columns
            if k != 3:
                assert all(after[i] == before[i] for i in after)
        else:
            rates = {r.id: r.rate for r in mixing.mix(docs, read(spark, SF, "labels")).collect()}
            assert {i: round(r.rate, 6) for i, r in after.items()} == {i: round(x, 6) for i, x in rates.items()}
        docs = out
    assert P.run(spark, SF).count() == docs.count()


def test_stages_take_odd_tables(spark):
    """Also with columns of the names that the stages use inside or add."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    odd = odd_documents(spark).withColumns({c: F.lit(f"x{c}") for c in ("rate", "n_tokens", "residual", "p_good", "component", "hits", "Score2")})
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for k, (_, step) in enumerate(P.STAGES):
            out = stage(step(spark, docs, SF), f"test-odd-{k}")
            assert out.count() <= docs.count()
            if k < 4:
                assert out.columns == columns
                assert out.where("score <> 'xscore' OR rate <> 'xrate'").count() == 0
            else:
                assert sorted(set(columns) - set(out.columns)) == [] and dict(out.dtypes)["rate"] == "double"
                assert out.where("score <> 'xscore' OR key <> 'xkey'").count() == 0
            docs = out


def test_empty_tables_start_no_python_worker(spark):
    made = empty(spark, "name string, score double, n int")
    assert made.dtypes == [("name", "string"), ("score", "double"), ("n", "int")] and made.count() == 0
    assert "ExistingRDD" not in made._jdf.queryExecution().toString()


def test_text_operators_hold_small_batches(spark):
    """Whatever the session had: rows of a Python worker's batch are bounded."""
    import pyarrow as pa

    from rollcall.llm import neardup, pii, quality

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(key), odd_documents(spark, False)
    labels = spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, quality int")

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

    try:
        for make in (lambda: quality.quality(docs, labels), lambda: neardup.near_duplicates(docs), lambda: pii.find_personal_data(docs)):
            for rows in ("10000", "0"):
                spark.conf.set(key, rows)
                make()
                seen = spark.range(2 * BATCH_ROWS + 5, numPartitions=1).mapInArrow(sizes, "n long").collect()
                assert sum(r.n for r in seen) == 2 * BATCH_ROWS + 5 and max(r.n for r in seen) <= BATCH_ROWS
        spark.conf.set(key, "10")
        small_batches(spark)
        assert spark.conf.get(key) == "10"
    finally:
        spark.conf.set(key, before)
