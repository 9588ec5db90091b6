"""Reward components as column expressions over a completions DataFrame.

Each function adds one score column and keeps every input row. All of them
are projections (no shuffle): they run inside whole-stage codegen next to
the scan; gold features come by a join on the distinct gold texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parsing as P
from ..functions.text import col, count_occurrences, find, py_lstrip, py_strip, py_words
from ..session import staged
from .execution import resolve_database, syntax_score
from .matching import result_score
from .ranks import salted_join


def _gold_features(df: DataFrame, gt_col: str, features, gold: DataFrame | None = None) -> DataFrame:
    """Gold SQL and its features (``features(frame with _g)``), once for each
    distinct gold text, joined back: generations of one prompt share it. ``gold``
    is a static frame with the texts, for a stream, which has no distinct ones: a
    text there as often as in the stream, so that the rows of a frequent one are
    dealt over many tasks (a stream's plan is not mended at run time)."""
    if gold is not None:
        counted = gold.groupBy(F.col(gt_col).alias("_gold")).agg(F.count(F.lit(1)).alias("_rows"))
        known = staged(features(P.add_gt_sql(counted, "_gold", "_g")).withColumnRenamed("_gold", gt_col), "gold")
        return salted_join(df, known, [gt_col], "_rows", how="left")
    texts = df.select(F.col(gt_col).alias("_gold")).distinct()
    return df.join(features(P.add_gt_sql(texts, "_gold", "_g")), F.col(gt_col).eqNullSafe(F.col("_gold")), "left").drop("_gold")


def _grams(d: DataFrame, sql: str, side: str) -> DataFrame:
    d = d.withColumn(f"_t{side}", P.tokenize_sql(F.col(sql)))
    return d.withColumns({f"_{side}{n}": P.ngram_set(f"_t{side}", n) for n in (1, 2, 3)})


_GOLD_COLS = ["_g", "_ig", "_tg", "_g1", "_g2", "_g3"]


def with_gold_features(df: DataFrame, gt_col: str, gold: DataFrame) -> DataFrame:
    """What both text rewards take of the gold, by one join with a static frame of
    the texts: for rewards called with ``joined``. The columns are ``_GOLD_COLS``."""
    return _gold_features(df, gt_col, lambda g: _grams(P.add_schema_items(g, "_g", "_ig"), "_g", "g"), gold)


def ngram_similarity_reward(df: DataFrame, sql_col: str, gt_col: str, out: str = "ngram_score", gold: DataFrame | None = None,
                            joined: bool = False) -> DataFrame:
    """2 × mean Jaccard of token 1/2/3-gram sets; 0 when either SQL or
    either token list is empty. ``gt_col`` holds raw gold text. Token lists and
    n-gram sets are columns of their own, computed once. ``joined``: ``df`` is one
    of ``with_gold_features``, whose columns stay."""
    d = _grams(df if joined else _gold_features(df, gt_col, lambda g: _grams(g, "_g", "g"), gold), sql_col, "p")
    d = P.add_shared(d, {f"_n{n}": (f"_p{n}", f"_g{n}") for n in (1, 2, 3)})
    sims = [P.jaccard(f"_p{n}", f"_g{n}", f"_n{n}") for n in (1, 2, 3)]
    score = F.when((F.col(sql_col) == "") | (F.col("_g") == "") | (F.size("_tp") == 0) | (F.size("_tg") == 0),
                   F.lit(0.0)).otherwise((sims[0] + sims[1] + sims[2]) / 3 * 2.0)
    return d.withColumn(out, score).drop("_tp", *[f"_{x}{n}" for x in "pn" for n in (1, 2, 3)], *([] if joined else ["_tg", "_g", "_g1", "_g2", "_g3"]))


def schema_linking_reward(df: DataFrame, sql_col: str, gt_col: str, out: str = "schema_score",
                          strict: bool = False, gold: DataFrame | None = None, joined: bool = False) -> DataFrame:
    """2 × Jaccard of referenced schema items (aliases resolved); 0 when
    either SQL is missing. Item sets are columns of their own, computed once.
    ``joined``: ``df`` is one of ``with_gold_features`` (not ``strict``), whose
    columns stay."""
    d = df if joined else _gold_features(df, gt_col, lambda g: P.add_schema_items(g, "_g", "_ig", strict), gold)
    d = P.add_shared(P.add_schema_items(d, sql_col, "_ip", strict), {"_in": ("_ip", "_ig")})
    score = F.when((F.col(sql_col) == "") | (F.col("_g") == ""), F.lit(0.0)).otherwise(2.0 * P.jaccard("_ip", "_ig", "_in"))
    return d.withColumn(out, score).drop("_ip", "_in", *([] if joined else ["_g", "_ig"]))


# --- fixed values: phrases counted as schema reasoning in thinking -------------
THINKING_INDICATORS = [
    "table", "columns", "join", "select", "where", "from",
    "schema", "foreign key", "primary key", "the question",
    "need to", "should", "looking at",
]
# --- end fixed values ---------------------------------------------------------


def _format_positions(df: DataFrame, text_col: str) -> DataFrame:
    """Marker positions as staged columns (each position is computed once
    and later rules refer to it by attribute, keeping expressions small)."""
    t = F.col(text_col)
    a_full, f_full = P.ANALYSIS_OPEN, P.FINAL_OPEN
    d = (df.withColumn("_a_full", find(t, a_full)).withColumn("_f_full", find(t, f_full))
         .withColumn("_p_idx", find(t, P.PARTIAL_ANALYSIS)).withColumn("_apos", find(t, "assistant"))
         .withColumn("_lstrip_an", py_lstrip(t).startswith("analysis")))
    d = (d.withColumn("_fpos", F.when(F.col("_apos") != -1, find(t, "final", F.col("_apos"))).otherwise(F.lit(-1)))
         .withColumn("_a_start", F.when(F.col("_a_full") != -1, F.col("_a_full") + len(a_full))
                     .when(F.col("_p_idx") != -1, F.col("_p_idx") + len(P.PARTIAL_ANALYSIS)).otherwise(F.lit(0))))
    return (d.withColumn("_end_after", find(t, P.ANALYSIS_CLOSE, F.col("_a_start")))
            .withColumn("_fin_after", find(t, f_full, F.col("_a_start")))
            .withColumn("_ret_after", F.when(F.col("_f_full") != -1,
                                             find(t, P.FINAL_CLOSE, F.col("_f_full") + len(f_full))).otherwise(F.lit(-1))))


_POS_COLS = ["_a_full", "_f_full", "_p_idx", "_apos", "_lstrip_an", "_fpos", "_a_start", "_end_after",
             "_fin_after", "_ret_after"]


def format_reward_rules(text, parsed: str = "parsed", sql_col: str = "sql") -> Column:
    """Per-rule contributions of the channel-format score as
    ``array<struct<rule string, delta double>>`` (zero-delta rules omitted).
    Needs the parsed ``struct<thinking, content>``, the extracted SQL and the
    staged marker positions (see ``format_reward``). Score = clamped sum."""
    t = col(text)
    c = F.col
    has_a, has_f = c("_a_full") != -1, c("_f_full") != -1
    has_pa = (c("_p_idx") != -1) | c("_lstrip_an")
    use_partial = ~has_a & ~has_f
    sect_a = c("_lstrip_an") | (F.instr(F.substr(t, F.lit(1), F.lit(50)), "analysis") > 0)
    sect_f = (F.instr(t, "final") > 0) & (c("_apos") != -1)
    eff_a = has_a | has_pa
    a_pos = F.when(has_a, c("_a_full")).when(c("_p_idx") != -1, c("_p_idx")).otherwise(F.lit(0))
    a_count = F.when(has_a, count_occurrences(t, P.ANALYSIS_OPEN)).otherwise(count_occurrences(t, P.PARTIAL_ANALYSIS))
    f_count = count_occurrences(t, P.FINAL_OPEN)
    thinking, content = c(f"{parsed}.thinking"), c(f"{parsed}.content")
    sql = c(sql_col)
    has_sql = py_strip(sql) != ""
    th_low = F.lower(thinking)
    n_ind = sum(F.when(F.instr(th_low, s) > 0, 1).otherwise(0) for s in THINKING_INDICATORS)
    sql_up = F.upper(py_strip(sql))
    fw = F.array_distinct(py_words(F.lower(content)))
    tw = F.array_distinct(py_words(th_low))
    sw = F.array_distinct(py_words(F.lower(sql)))
    overlap = F.size(F.array_except(F.array_intersect(fw, tw), sw))
    rules = [
        ("partial_analysis_section", use_partial & sect_a, 0.2),
        ("partial_final_section", use_partial & sect_f, 0.2),
        ("partial_ordering", use_partial & sect_a & (c("_apos") > 10) & (c("_fpos") > c("_apos")), 0.2),
        ("partial_single_assistant", use_partial & (count_occurrences(t, "assistant") == 1), 0.2),
        ("analysis_open", eff_a, 0.2),
        ("analysis_closed", eff_a & (c("_end_after") != -1)
         & ((c("_fin_after") == -1) | (c("_end_after") < c("_fin_after"))), 0.1),
        ("final_open", has_f, 0.2),
        ("final_closed", has_f & (c("_ret_after") != -1), 0.1),
        ("ordering", eff_a & has_f & (a_pos < c("_f_full")), 0.2),
        ("no_duplicates", (a_count == 1) & (f_count == 1), 0.2),
        ("thinking_length", (thinking != "") & (F.size(py_words(thinking)) > 20), 0.25),
        ("schema_indicators", (thinking != "") & (n_ind >= 2), 0.25),
        ("has_sql", has_sql, 0.25),
        ("sql_starts_correctly", has_sql & (sql_up.startswith("SELECT") | sql_up.startswith("WITH")), 0.25),
        ("final_text_without_sql", (content != "") & (sql == "") & (F.size(py_words(content)) > 20), -0.5),
        ("analysis_without_final", ~has_f & has_a, -1.0),
        ("no_format_no_sql", ~has_f & ~has_a & (sql == ""), -1.5),
        ("no_final_but_sql", ~has_f & ~has_a & (sql != ""), -1.0),
        ("final_contains_reasoning", has_f & (content != "") & (sql != "") & (thinking != "")
         & (overlap > F.size(sw)), -0.5),
    ]
    arr = F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(float(d)).alias("delta")))
                    for name, cond, d in rules])
    return F.filter(arr, lambda x: x.isNotNull())


# --- fixed values: format rules and their score deltas -----------------------
FORMAT_RULE_DELTAS = [
    ("partial_analysis_section", 0.2), ("partial_final_section", 0.2), ("partial_ordering", 0.2),
    ("partial_single_assistant", 0.2), ("analysis_open", 0.2), ("analysis_closed", 0.1),
    ("final_open", 0.2), ("final_closed", 0.1), ("ordering", 0.2), ("no_duplicates", 0.2),
    ("thinking_length", 0.25), ("schema_indicators", 0.25), ("has_sql", 0.25),
    ("sql_starts_correctly", 0.25), ("final_text_without_sql", -0.5), ("analysis_without_final", -1.0),
    ("no_format_no_sql", -1.5), ("no_final_but_sql", -1.0), ("final_contains_reasoning", -0.5),
]
# --- end fixed values ----------------------------------------------------------


def scoring_reasons(scored: DataFrame, rules_col: str = "format_rules", by: list[str] = ()) -> DataFrame:
    """How often each format rule fired and its total contribution.

    The rule set is fixed, so this is one wide aggregate (``count_if`` per
    rule, partial aggregation on the map side) reshaped to one row per rule;
    no per-rule row explosion reaches the shuffle."""
    names = F.transform(F.col(rules_col), lambda x: x["rule"])
    d = scored.withColumn("_rule_names", names)
    aggs = [F.count_if(F.array_contains("_rule_names", r)).alias(f"n__{i}") for i, (r, _) in enumerate(FORMAT_RULE_DELTAS)]
    wide = d.groupBy(*by).agg(*aggs)
    parts = [F.struct(F.lit(r).alias("rule"), F.col(f"n__{i}").alias("n"),
                      (F.col(f"n__{i}") * F.lit(dl)).alias("total_delta"))
             for i, (r, dl) in enumerate(FORMAT_RULE_DELTAS)]
    return wide.select(*by, F.inline(F.array(*parts))).where(F.col("n") > 0)


def format_reward(df: DataFrame, text_col: str, out: str = "format_score", with_rules: bool = False) -> DataFrame:
    """Channel-format score in [-1.5, 2]: sum of rule deltas, clamped."""
    d = P.add_parsed(df, text_col, "_fparsed")
    d = P.add_sql(d, text_col, "_fsql", content_col="_fparsed.content")
    d = _format_positions(d, text_col)
    d = d.withColumn("_rules", format_reward_rules(F.col(text_col), "_fparsed", "_fsql")) \
        .drop("_fparsed", "_fsql", *_POS_COLS)
    raw = F.aggregate("_rules", F.lit(0.0), lambda acc, x: acc + x["delta"])
    d = d.withColumn(out, F.greatest(F.lit(-1.5), F.least(F.lit(2.0), raw)))
    return d.withColumnRenamed("_rules", "format_rules") if with_rules else d.drop("_rules")


def schema_mentions(df: DataFrame, thinking_col: str, sql_col: str, schema_col: str) -> DataFrame:
    """Which prompt-schema tables/columns occur (as substrings) in the
    thinking and in the SQL. Per-row ``filter`` over the row's own name
    arrays; no theta join."""
    th, sq = F.lower(F.col(thinking_col)), F.lower(F.col(sql_col))
    tabs, cols = F.col(f"{schema_col}.tables"), F.col(f"{schema_col}.columns")
    return (df.withColumn("tables_in_thinking", F.filter(tabs, lambda x: F.instr(th, x) > 0))
            .withColumn("columns_in_thinking", F.filter(cols, lambda x: F.instr(th, x) > 0))
            .withColumn("tables_in_sql", F.filter(tabs, lambda x: F.instr(sq, x) > 0))
            .withColumn("columns_in_sql", F.filter(cols, lambda x: F.instr(sq, x) > 0)))


def with_prompt_schema(df: DataFrame, prompt_col: str, out: str = "schema") -> DataFrame:
    """Adds the tables and columns that the prompt names, extracted once for each
    distinct prompt and joined back: generations of one prompt share it."""
    known = df.select(F.col(prompt_col).alias("_prompt")).distinct().withColumn(out, P.extract_prompt_schema(F.col("_prompt")))
    return df.join(known, F.col(prompt_col).eqNullSafe(F.col("_prompt")), "left").drop("_prompt")


def thinking_quality_reward(df: DataFrame, text_col: str, prompt_col: str, out: str = "thinking_score",
                            schema_col: str | None = None) -> DataFrame:
    """Schema grounding, length band and thinking→SQL coherence, in [0, 2].

    Tables/columns named in the prompt are tested as substrings of the
    lower-cased thinking and SQL with ``filter`` over the (per-row, small)
    name arrays. ``schema_col``: the prompt's schema where it is known already
    (``with_prompt_schema`` over the prompts); else it is extracted once for
    each distinct prompt.
    """
    df = with_prompt_schema(df, prompt_col, "_schema") if schema_col is None else df.withColumn("_schema", F.col(schema_col))
    d = P.add_parsed(df, text_col, "_tparsed")
    d = P.add_sql(d, text_col, "_sql", content_col="_tparsed.content")
    d = d.withColumn("_th", F.col("_tparsed.thinking")).drop("_tparsed")
    th = F.lower(F.col("_th"))
    sq = F.lower(F.col("_sql"))
    tabs, cols = F.col("_schema.tables"), F.col("_schema.columns")
    t_th = F.filter(tabs, lambda x: F.instr(th, x) > 0)
    c_th = F.filter(cols, lambda x: F.instr(th, x) > 0)
    t_both = F.filter(t_th, lambda x: F.instr(sq, x) > 0)
    c_both = F.filter(c_th, lambda x: F.instr(sq, x) > 0)
    nt, nc = F.size(t_th), F.size(c_th)
    wc = F.size(py_words(th))
    t_ratio = F.try_divide(F.size(t_both), nt)
    c_ratio = F.try_divide(F.size(c_both), nc)
    score = (F.when(nt >= 2, 0.4).when(nt >= 1, 0.2).otherwise(0.0)
             + F.when(nc >= 3, 0.4).when(nc >= 1, 0.2).otherwise(0.0)
             + F.when((wc >= 30) & (wc <= 400), 0.4).when(((wc >= 15) & (wc < 30)) | ((wc > 400) & (wc <= 600)), 0.2)
             .otherwise(0.0)
             + F.when((F.col("_sql") != "") & (F.size(tabs) > 0) & (nt > 0),
                      F.when(t_ratio >= 0.5, 0.4).when(t_ratio >= 0.25, 0.2).otherwise(0.0)).otherwise(0.0)
             + F.when((F.col("_sql") != "") & (F.size(cols) > 0) & (nc > 0),
                      F.when(c_ratio >= 0.3, 0.4).when(c_ratio >= 0.15, 0.2).otherwise(0.0)).otherwise(0.0))
    guarded = F.when(F.length(py_strip(F.col("_th"))) < 10, F.lit(0.0)) \
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), score)))
    return d.withColumn(out, guarded).drop("_th", "_sql", "_schema")


def syntax_execution_reward(df: DataFrame, sql_col: str, db_path_col: str, success_col: str,
                            out: str = "syntax_score") -> DataFrame:
    """0 without SQL, database or recorded outcome; +2 when the statement ran; -2
    when it failed. ``success_col`` comes from the execution table (joined on
    (db, sql))."""
    has_sql = F.coalesce(py_strip(F.col(sql_col)), F.lit("")) != ""
    return df.withColumn(out, syntax_score(has_sql, F.coalesce(F.col(db_path_col), F.lit("")) != "", F.col(success_col)))


def score_texts(df: DataFrame, gold: DataFrame, catalogue: DataFrame, text_col: str = "completion",
                gt_col: str = "ground_truth_sql", db_col: str = "database_name") -> DataFrame:
    """The part of the scores that needs no outcome: ``sql``, ``db_path`` and the
    scores of schema linking and n-grams. Works on a batch and on a stream: gold
    texts and databases are static frames."""
    d = P.add_parsed(df, text_col)
    d = P.add_sql(d, text_col, "sql", content_col="parsed.content")
    d = resolve_database(d, db_col, catalogue)
    d = with_gold_features(d, gt_col, gold)
    d = schema_linking_reward(d, "sql", gt_col, joined=True)
    return ngram_similarity_reward(d, "sql", gt_col, joined=True).drop(*_GOLD_COLS)


def score_outcomes(df: DataFrame) -> DataFrame:
    """The scores of recorded outcomes (``success``, ``n_pred``, ``n_gt``,
    ``n_common``, ``pred_cols``, ``gt_cols``; NULL where there is none). Of ``sql``
    and ``db_path`` it asks only whether they are empty."""
    d = syntax_execution_reward(df, "sql", "db_path", "success")
    for c in ("n_pred", "n_gt", "n_common", "pred_cols", "gt_cols"):
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    has = py_strip(F.col("sql")) != ""
    d = d.withColumn("exact_match", (F.col("n_common") == F.col("n_pred")) & (F.col("n_common") == F.col("n_gt")))
    return result_score(d, has_gold=F.col("db_path") != "", pred_ok=has & F.coalesce(F.col("success"), F.lit(False)))


def score_with_outcomes(df: DataFrame, gold: DataFrame, catalogue: DataFrame, text_col: str = "completion",
                        gt_col: str = "ground_truth_sql", db_col: str = "database_name") -> DataFrame:
    """All four scores of raw completions that carry their recorded outcome."""
    return score_outcomes(score_texts(df, gold, catalogue, text_col, gt_col, db_col))
