"""Mixing a corpus to target domain weights, with soft membership.

Domains are the classes of a labelled table. A naive Bayes classifier over
binned measures of a text and hits of a lexicon, learnt from the labelled rows,
gives every document the posterior of each domain (rounded to ``STEP``).
Documents get a nonnegative rate; the expected tokens of domain k are
sum(rate x tokens x posterior_k). Projected gradient descent, from rate 1,
minimises sum_k (expected_k - target_k)**2 / natural_k, natural_k being the
expected tokens at rate 1, with steps that are scaled by the tokens of a group:

    e_k = (expected_k - target_k) / natural_k
    rate <- max(0, rate - sum_k(posterior_k x e_k))

It ends when no rate moves by more than ``tolerance`` in a step, that is when
the projected gradient is that small, or after ``rounds`` steps; domains whose
posteriors hardly differ need many. The result tells which: ``unsettled`` is the
largest move of the last step, 0 if within the tolerance, and ``residual`` what
stays of the objective, as the root of its share of all tokens: 0 where the
targets are met, more where nonnegative rates cannot meet them all.

Documents with equal posteriors always have equal rates, so the descent runs
over the table of distinct posteriors with their token sums, which is summed up
where the documents are. The number of distinct posteriors is bounded by the
number of bin combinations (6048), whatever the corpus, so all iterations over
that table are one query, and its rates are broadcast to the documents.

Main path: DataFrame functions only.

Defined results: a null or blank text has 0 tokens, its rate still follows its
posteriors; without labelled rows all posteriors are equal; a target of a domain
that has no expected tokens can't be met and is left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from .storage import stage

#: Domains by (quality, toxic), and their default target shares.
DOMAINS = {"good": 0.90, "good_toxic": 0.02, "low": 0.06, "low_toxic": 0.02}
STEP = 1e-3
#: Upper edges of the bins of each measure.
EDGES = {
    "word_length": (3.0, 4.5, 5.5, 7.0, 9.0),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "signs": (0.005, 0.03, 0.08, 0.15, 0.3),
    "capitals": (0.02, 0.05, 0.1, 0.3, 0.6),
    "lexicon": (0.5, 1.5, 3.5),
}


def domain(quality: Column, toxic: Column) -> Column:
    names = list(DOMAINS)
    return F.when(quality.isin(0, 1) & toxic.isin(0, 1), F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.lit(1) + (1 - quality) * 2 + toxic).cast("int")))


def lexicon(docs: DataFrame, labelled: DataFrame, domains: list[str], size: int = 256, min_docs: int = 5,
            bound: int = 3000) -> list[str]:
    """The words most typical of the given domains, by log odds of document
    frequency, over at most ``bound`` labelled documents inside and outside."""
    inside = F.col("domain").isin(domains)
    pick = reduce(DataFrame.union, [
        labelled.where(c).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(bound) for c in (inside, ~inside)])
    a, b = pick.agg(F.sum(inside.cast("long")), F.sum((~inside).cast("long"))).first()
    if not a or not b:
        return []
    words = docs.join(F.broadcast(pick.withColumnRenamed("id", "l_id")), F.col("id") == F.col("l_id")) \
        .select(inside.alias("hit"), F.explode(F.array_distinct("ws")).alias("w"))
    odds = words.groupBy("w").agg(F.sum(F.col("hit").cast("long")).alias("x"), F.sum((~F.col("hit")).cast("long")).alias("y")) \
        .where(F.col("x") >= min_docs) \
        .withColumn("odds", F.log((F.col("x") + 0.5) / (a + 1)) - F.log((F.col("y") + 0.5) / (b + 1)))
    return [r.w for r in odds.where("odds > 3").orderBy(F.desc("odds"), "w").limit(size).collect()]


def measures(words: list[str]) -> list[Column]:
    """n_tokens and the bins of each measure of column ``text``."""
    n = F.greatest(F.size("ws"), F.lit(1))
    chars = F.greatest(F.length("text"), F.lit(1))
    drop = lambda chars_: F.length("text") - F.length(F.translate("text", chars_, ""))
    raw = {
        "word_length": F.length("text") / n,
        "distinct": F.size(F.array_distinct("ws")) / n,
        "signs": drop("!|*%&$#=+<>{}") / chars,
        "capitals": drop("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        "lexicon": F.size(F.array_intersect("ws", F.array(*[F.lit(w) for w in words]))) if words else F.lit(0),
    }
    bins = [sum(((raw[k] > F.lit(e)).cast("int") for e in edges), F.lit(0)).alias(k) for k, edges in EDGES.items()]
    return [F.size("ws").cast("long").alias("n_tokens"), *bins]


def posteriors(rows: DataFrame, labelled: DataFrame, names: list[str]) -> tuple[list[Column], list[Column]]:
    """Naive Bayes: the domains' log scores over the bin columns, and their
    rounded posteriors over these. The tables (bins x domains) are literals."""
    known = rows.join(labelled.withColumnRenamed("id", "l_id"), F.col("id") == F.col("l_id"))
    # the counts of one row for each measure, bin and domain: a few dozen rows
    counts = known.select("domain", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in EDGES])).alias("m")) \
        .groupBy("domain", "m.k", "m.v").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {(r.domain, r.k, r.v): r.n for r in counts}
    first = next(iter(EDGES))
    size = {d: sum(n.get((d, first, v), 0) for v in range(len(EDGES[first]) + 1)) for d in names}
    every = sum(size.values())

    def log_score(d: str) -> Column:
        prior = math.log((size[d] + 1) / (every + len(names)))
        terms = [F.element_at(F.array(*[F.lit(math.log((n.get((d, k, v), 0) + 0.5) / (size[d] + 0.5 * (len(e) + 1))))
                                        for v in range(len(e) + 1)]), F.col(k) + 1) for k, e in EDGES.items()]
        return reduce(lambda a, b: a + b, terms, F.lit(prior))

    logs = [F.col(f"z_{d}") for d in names]
    top = F.greatest(*logs)
    total = reduce(lambda a, b: a + b, [F.exp(z - top) for z in logs])
    return [log_score(d).alias(f"z_{d}") for d in names], \
        [F.round(F.exp(F.col(f"z_{d}") - top) / total, int(-math.log10(STEP))).alias(f"p_{d}") for d in names]


def _rate(history: list[list[float]], names: list[str]) -> Column:
    """The rate after the steps of ``history``, from the row's rate and posteriors.

    The steps are one constant array, which Spark hands to its generated code as
    an object: all rounds share that code. As numbers of their own, they were
    compiled and kept anew by every executor in every round."""
    if not history:
        return F.col("rate")
    p = [F.col(f"p_{d}") for d in names]
    steps = F.array(*[F.array(*[F.lit(e) for e in step]) for step in history])
    return F.aggregate(steps, F.col("rate"), lambda r, step: F.greatest(
        F.lit(0.0), r - reduce(lambda a, b: a + b, [F.get(step, F.lit(k)) * x for k, x in enumerate(p)])))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _descent(groups: DataFrame, names: list[str], natural: list[float], target: list[float], rounds: int, tolerance: float) -> Row:
    """(steps, now, moved): the errors that each step used, the expected tokens after
    the last one and its largest move. All steps are one query over one row: a query
    for each left its plan and metrics with the driver."""
    # at most as many structs as there are bin combinations
    g = F.col("g")
    rows = groups.agg(F.collect_list(F.struct("n_tokens", *[F.col(f"p_{d}") for d in names])).alias("g"))

    def errors(now: Column) -> Column:
        return F.array(*[(F.get(now, F.lit(k)) - F.lit(t)) / F.lit(n) if n > 0 else F.lit(0.0)
                         for k, (n, t) in enumerate(zip(natural, target))])

    def moved(r: Column, e: Column) -> Column:
        return F.zip_with(r, g, lambda r, x: F.greatest(F.lit(0.0), r - reduce(
            lambda a, b: a + b, [F.get(e, F.lit(k)) * x[f"p_{d}"] for k, d in enumerate(names)])))

    def expected(r: Column) -> Column:
        return F.array(*[F.aggregate(F.zip_with(r, g, lambda r, x: r * x["n_tokens"] * x[f"p_{d}"]), F.lit(0.0), lambda a, b: a + b)
                         for d in names])

    def step(s: Column, _: Column) -> Column:
        after = _let(errors(s["now"]), lambda e: _let(moved(s["r"], e), lambda r: F.struct(
            r.alias("r"), expected(r).alias("now"), F.concat(s["steps"], F.array(e)).alias("steps"),
            F.array_max(F.zip_with(r, s["r"], lambda a, b: F.abs(a - b))).alias("moved"))))
        return F.when((F.size(s["steps"]) > 0) & (s["moved"] <= F.lit(tolerance)), s).otherwise(after)

    start = F.struct(F.transform(g, lambda x: F.lit(1.0)).alias("r"), F.array(*[F.lit(n) for n in natural]).alias("now"),
                     F.array().cast("array<array<double>>").alias("steps"), F.lit(0.0).alias("moved"))
    return rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.struct(
        s["steps"].alias("steps"), s["now"].alias("now"), s["moved"].alias("moved"))).alias("s")).collect()[0].s


def solve(groups: DataFrame, names: list[str], shares: list[float], rounds: int = 120, tolerance: float = 1e-4) -> tuple[DataFrame, float, float]:
    """(``groups`` with their ``rate``, residual, unsettled). ``groups``: n_tokens, p_*."""
    groups = groups.withColumn("rate", F.lit(1.0))
    r = groups.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in names]).first()
    natural = [float(r[d] or 0) for d in names]
    whole = sum(natural)
    target = [x / sum(shares) * whole for x in shares]
    now, history, moved = natural, [], 0.0
    if whole > 0 and rounds > 0:
        history, now, moved = _descent(groups, names, natural, target, rounds, tolerance)
    left = sum(n * ((x - t) / n) ** 2 for x, t, n in zip(now, target, natural) if n > 0)
    residual = math.sqrt(left / whole) if whole > 0 else 0.0
    return groups.withColumn("rate", _rate(history, names)), residual, moved if moved > tolerance else 0.0


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        targets: dict[str, float] | None = None, rounds: int = 120) -> DataFrame:
    """(id, key, n_tokens, rate, residual, unsettled, p_<domain>...) of every row; ``key`` is the
    xxhash64 of its text. ``labels`` has columns quality and toxic."""
    targets = targets or DOMAINS
    names = list(targets)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")) \
        .withColumn("ws", F.array_remove(F.split(F.lower("text"), r"\s+"), ""))
    # one label a document: the least pair where several rows disagree
    labelled = labels.select(F.col(label_id).cast("long").alias("id"), domain(F.col("quality"), F.col("toxic")).alias("domain")) \
        .where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    words = lexicon(rows, labelled, [d for d in names if d.endswith("toxic")])
    measured = stage(rows.select("id", F.xxhash64("text").alias("key"), *measures(words)), "mixing")
    score, share = posteriors(measured, labelled, names)
    soft = measured.select("id", "key", "n_tokens", *score).select("id", "key", "n_tokens", *share)
    groups = stage(soft.groupBy(*[f"p_{d}" for d in names]).agg(F.sum("n_tokens").alias("n_tokens")), "mixing-groups")
    rates, residual, unsettled = solve(groups, names, list(targets.values()), rounds)
    rates = stage(rates.select(F.col("rate"), *[F.col(f"p_{d}").alias(f"q_{d}") for d in names]), "mixing-rates")
    same = reduce(lambda a, b: a & b, [F.col(f"p_{d}").eqNullSafe(F.col(f"q_{d}")) for d in names])
    return soft.join(F.broadcast(rates), same).select(
        "id", "key", "n_tokens", "rate", F.lit(residual).alias("residual"), F.lit(unsettled).alias("unsettled"), *[f"p_{d}" for d in names])
