"""Toxicity, quality, language and mixing: held-out accuracy, odd tables."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import empty_documents, odd_documents, odd_labels, prose
from rollcall.llm import crf, langid, mixing, quality, toxicity
from rollcall.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def scored(spark, name, label):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r[label] == 1]
    bad = [r.score for r in rows if r[label] == 0]
    assert all(0 <= r.score <= 1 for r in rows)
    return np.mean([float(a > b) + 0.5 * float(a == b) for a, b in itertools.product(good, bad)])


def test_toxicity_held_out(spark):
    assert scored(spark, "op1_toxicity", "toxic") > 0.9


def test_quality_held_out(spark):
    assert scored(spark, "op7_quality", "quality") > 0.95


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_language"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_misspellings_share_ngrams():
    rng = random.Random(1)
    toxic = [prose(i, 40) + " idiotic" for i in range(60)]
    clean = [prose(100 + i, 40) + " pleasant" for i in range(60)]
    model = toxicity.fit(pa.chunked_array([pa.array(toxic + clean)]), [1] * 60 + [0] * 60)
    bad, good = toxicity.score(pa.array([prose(rng.randrange(500, 900), 40) + " idiootic idotic", prose(990, 40) + " pleasantly"]), *model)
    assert bad > 0.5 > good


def test_words_of_a_mixed_text_switch_language():
    rng = random.Random(2)
    words = {"aa": ["zorn", "zirt", "zalp", "zund"], "bb": ["mula", "melo", "mira", "mano"]}
    texts = [" ".join(rng.choice(words[k]) for _ in range(30)) for k in ("aa", "bb") for _ in range(40)]
    w, t = langid.fit(pa.chunked_array([pa.array(texts)]), ["aa"] * 40 + ["bb"] * 40, ["aa", "bb"])
    mixed = pa.array(["zorn zirt zund zalp zorn mula mira melo mano mula"])
    (_, _, _, g), = langid.word_posteriors(mixed, w, t)
    assert g[:5, 0].min() > 0.5 and g[5:, 1].min() > 0.5
    assert langid.predict(pa.array([None, "", "12 !?", "zorn"]), w, t, ["aa", "bb"])[0] == ["und", "und", "und", "aa"]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    size, k = np.array([4, 1, 3]), 3
    score, trans = rng.normal(size=(4, 3, k)), rng.normal(size=(k, k))
    g, pairs = crf.forward_backward(score, size, trans, pairs=True)
    expect_pairs = np.zeros((k, k))
    for s, n in enumerate(size):
        paths = list(itertools.product(range(k), repeat=n))
        p = np.exp([sum(score[t, s, y[t]] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n)) for y in paths])
        p /= p.sum()
        for t in range(n):
            assert np.allclose(g[t, s], [sum(q for q, y in zip(p, paths) if y[t] == c) for c in range(k)])
        for q, y in zip(p, paths):
            for t in range(1, n):
                expect_pairs[y[t - 1], y[t]] += q
    assert np.allclose(pairs, expect_pairs)


def test_lines_get_marginals():
    good = ["The first line reads well.\nAnd the second one too, it does." for _ in range(30)]
    bad = ["buy!! NOW!! ### $$$\n*** %%% &&& !!! |||" for _ in range(30)]
    w, t, curve, share = quality.fit(pa.chunked_array([pa.array(good + bad)]), [1] * 30 + [0] * 30)
    (_, _, doc, weight, p), = quality.line_marginals(pa.array([good[0] + "\n\n" + bad[0], None]), w, t)
    assert len(doc) == 4 and share == 0.5
    s = quality.score(pa.array([good[0], bad[0], None, "", "\n \n"]), w, t, curve, share)
    assert s[0] > 0.9 and s[1] < 0.1 and s[2] == s[3] == s[4]


def test_odd_tables(spark):
    docs, labels, empty = odd_documents(spark), odd_labels(spark), empty_documents(spark)
    for run in (lambda d, l: toxicity.toxicity(d, l), lambda d, l: quality.quality(d, l)):
        for d, l in ((docs, labels), (docs, labels.limit(0)), (empty, labels), (docs, labels.where("toxic = 0 and quality = 0"))):
            rows = run(d, l).collect()
            assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality.quality(docs, labels, keep=tuple(docs.columns))
    assert set(docs.columns) <= set(kept.columns) and kept.count() == docs.count()
    for d, l in ((docs, docs), (docs, empty), (empty, docs)):
        rows = langid.languages(d, l).collect()
        assert len(rows) == d.count()
        assert all(r.lang_pred == "und" for r in rows if r.id in (3, 4, 5)) and all(0 <= r.score <= 1 for r in rows)


def brute_rates(p, n, target, tolerance=1e-4):
    natural, r = p.T @ n, np.ones(len(n))
    while True:
        e = (p.T @ (r * n) - target) / np.where(natural > 0, natural, np.inf)
        new = np.maximum(0, r - p @ e)
        if np.abs(new - r).max() <= tolerance:
            return new
        r = new


def test_mixing_equals_plain_descent(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    names = list(mixing.DOMAINS)
    p, n = rows[[f"p_{d}" for d in names]].to_numpy(), rows["n_tokens"].to_numpy(float)
    shares = np.array(list(mixing.DOMAINS.values()))
    target = shares / shares.sum() * (p.T @ n).sum()
    assert np.allclose(rows["rate"], brute_rates(p, n, target), atol=2e-4)
    assert np.abs(p.T @ (n * rows["rate"]) - target).max() < 1e-3 * target.max() and (rows["rate"] >= 0).all()
    assert rows["residual"].nunique() == 1 and rows["residual"][0] < 1e-3 and (rows["unsettled"] == 0).all()


def groups(spark, rows):
    return spark.createDataFrame(rows, "n_tokens long, p_a double, p_b double")


def test_unreachable_targets_report_the_residual(spark):
    """No group leans to b by more than a fifth, but b wants nine tenths."""
    rows = [(1000, 0.9, 0.1), (500, 0.8, 0.2)]
    rates, residual, _ = mixing.solve(groups(spark, rows), ["a", "b"], [0.1, 0.9], tolerance=1e-7)
    r = {x.p_a: x.rate for x in rates.collect()}
    natural, target = np.array([1300.0, 200.0]), np.array([150.0, 1350.0])

    def objective(x, y):
        got = x * 1000 * np.array([0.9, 0.1]) + y * 500 * np.array([0.8, 0.2])
        return float(((got - target) ** 2 / natural).sum())

    here = objective(r[0.9], r[0.8])
    grid = [objective(max(0, r[0.9] + dx), max(0, r[0.8] + dy)) for dx in (-0.02, 0, 0.02) for dy in (-0.02, 0, 0.02)]
    assert r[0.9] == 0 and r[0.8] > 1 and here <= min(grid) + 1e-3
    assert residual > 0.1 and np.isclose(residual, np.sqrt(here / 1500), rtol=1e-3)
    met, zero, moved = mixing.solve(groups(spark, [(1000, 1.0, 0.0), (10, 0.0, 1.0)]), ["a", "b"], [0.5, 0.5], tolerance=1e-6)
    assert zero < 1e-5 and moved == 0 and {x.p_a: round(x.rate, 3) for x in met.collect()} == {1.0: 0.505, 0.0: 50.5}


def test_an_unfinished_descent_tells(spark):
    slow = [(1000, 0.51, 0.49), (900, 0.49, 0.51)]
    _, residual, moved = mixing.solve(groups(spark, slow), ["a", "b"], [0.52, 0.48], rounds=3, tolerance=1e-9)
    assert moved > 1e-9 and residual > 0
    # written tables in between change nothing
    rates, _, moved = mixing.solve(groups(spark, [(1000, 0.8, 0.2), (900, 0.2, 0.8)]), ["a", "b"], [0.6, 0.4], tolerance=1e-10)
    p, n = np.array([[0.8, 0.2], [0.2, 0.8]]), np.array([1000.0, 900.0])
    expect = brute_rates(p, n, np.array([0.6, 0.4]) * 1900, 1e-10)
    assert moved == 0 and np.allclose(sorted(x.rate for x in rates.collect()), sorted(expect), atol=1e-8)


def test_mixing_odd_tables(spark):
    docs, labels, empty = odd_documents(spark), odd_labels(spark), empty_documents(spark)
    for d, l in ((docs, labels), (docs, labels.limit(0)), (empty, labels)):
        rows = mixing.mix(d, l).collect()
        assert len(rows) == d.count()
        assert all(r.rate >= 0 and r.n_tokens >= 0 for r in rows)
        assert all(r.n_tokens == 0 for r in rows if r.id in (3, 4, 5))
    reweighed = mixing.mix(docs, labels, targets={"good": 0.5, "low": 0.5})
    assert reweighed.select(F.sum("n_tokens")).first()[0] > 0


def test_rounds_of_the_descent_share_their_code(spark):
    """No class is compiled anew for the numbers or the count of the steps."""
    rows = spark.range(4).select(F.lit(1.0).alias("rate"), (F.col("id") / 4).alias("p_a"), (F.col("id") / 7).alias("p_b")).where("p_a > 0")

    def code(history):
        plan = rows.select(mixing._rate(history, ["a", "b"]).alias("r"))._jdf.queryExecution()
        return spark._jvm.PythonSQLUtils.explainString(plan, "codegen").split("Generated code:")[1:]

    assert len(code([[0.25, 0.1]])) == 1 and code([[0.25, 0.1]]) == code([[0.3, 0.7], [0.1, -0.2]])


def test_queries_of_the_descent_do_not_grow_with_its_steps(spark):
    """The driver keeps the plan and metrics of every query."""
    store = spark._jsparkSession.sharedState().statusStore()

    def queries(rounds):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = store.executionsCount()
        _, _, moved = mixing.solve(groups(spark, [(1000, 0.51, 0.49), (900, 0.49, 0.51)]), ["a", "b"], [0.52, 0.48], rounds, 1e-12)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert moved > 0
        return store.executionsCount() - before

    assert queries(30) == queries(3) <= 3
