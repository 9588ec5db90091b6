"""Dataset preparation: prompt rendering, token counts, filters with
reasons, length statistics.

Every chat record is one row with ``messages array<struct<role, content,
thinking>>``; all per-record work is array higher-order functions inside a
projection (no explode, no shuffle). Reports aggregate with partial
aggregation; exact percentiles select ranks among counted lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import LengthLimits
from ..functions import parsing as P
from ..functions.text import col, py_strip, py_words
from . import tools as T
from .ranks import counted_values, quantiles

# --- fixed values: chat template text -----------------------------------------
MODEL_IDENTITY = "You are ChatGPT, a large language model trained by OpenAI."
KNOWLEDGE_CUTOFF = "2024-06"
DEFAULT_REASONING_EFFORT = "medium"
CHANNELS_LINE = "# Valid channels: analysis, commentary, final. Channel must be included for every message."
THINKING_SCAFFOLD = (
    "\n\n# HOW YOU SHOULD THINK AND ANSWER\n\n"
    "First draft your thinking process (inner monologue) until you arrive at a response.\n\n"
    "Your thinking process must follow the template below:"
    "[THINK]Your thoughts or/and draft, like working through an exercise on scratch paper. "
    "Be as casual and as long as you want until you are confident to generate the response "
    "to the user.[/THINK]Here, provide a self-contained response."
)
# Prompt-length histogram bin edges (last bin open-ended).
LENGTH_BINS = [0, 256, 512, 1024, 1536, 2048, 3072, 4096]
# --- end fixed values -----------------------------------------------------------

# Native token rule: runs of letters/digits/underscore, or one other
# non-space character. Spelled with explicit classes so Java and RE2 agree.
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\x0B\f\r ]"


def count_tokens(text) -> Column:
    """Token count with the native rule (JVM-side). A vocabulary's own count
    (``tokens.Vocabulary.count``) can stand in its place wherever ``count`` is a
    parameter."""
    return F.size(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(TOKEN_RE), 0))


def prompt_messages(messages) -> Column:
    """Non-assistant messages as ``struct<role, content>``."""
    return F.transform(F.filter(col(messages), lambda m: m["role"] != "assistant"),
                       lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def append_scaffold(messages, scaffold: str = THINKING_SCAFFOLD) -> Column:
    """Append the thinking instructions to every system message."""
    return F.transform(col(messages), lambda m: F.struct(
        m["role"].alias("role"),
        F.when(m["role"] == "system", F.concat(F.coalesce(m["content"], F.lit("")), F.lit(scaffold)))
        .otherwise(m["content"]).alias("content")))


def first_by_role(messages, role: str) -> Column:
    """First message with the role (NULL when none)."""
    return F.get(F.filter(col(messages), lambda m: m["role"] == role), 0)


def prompt_text(prompt) -> Column:
    """Last user message content, else the last message's content, else ''."""
    p = col(prompt)
    users = F.filter(p, lambda m: m["role"] == "user")
    return F.coalesce(F.get(users, F.size(users) - 1)["content"], F.get(p, F.size(p) - 1)["content"], F.lit(""))


def completion_text(completion) -> Column:
    """Element 0's content of a message-list completion ('' when empty)."""
    return F.coalesce(F.get(col(completion), 0)["content"], F.lit(""))


def system_block(date: str, reasoning_effort: str = DEFAULT_REASONING_EFFORT, builtin: list[str] | None = None,
                 tools_block: Column | None = None) -> Column:
    """The system preamble. ``builtin``: names of built-in tools (None: no
    section); a row with a tools block gets the line on their channel."""
    text = ("<|start|>system<|message|>" + MODEL_IDENTITY + "\n" + f"Knowledge cutoff: {KNOWLEDGE_CUTOFF}\n"
            + f"Current date: {date}\n\n" + f"Reasoning: {reasoning_effort}\n\n"
            + ("" if builtin is None else "# Tools\n\n" + T.builtin_tools(builtin)) + CHANNELS_LINE)
    calls = F.lit("") if tools_block is None else F.when(tools_block.isNotNull(), F.lit(T.CALLS_LINE)).otherwise(F.lit(""))
    return F.concat(F.lit(text), calls, F.lit("<|end|>"))


def developer_block(instructions: Column, tools_block: Column | None = None) -> Column:
    """Instructions and tools; nothing if there are neither."""
    block = F.lit(None).cast("string") if tools_block is None else tools_block
    dev = F.coalesce(instructions, F.lit(""))
    parts = F.concat(F.when(dev != "", F.concat(F.lit("# Instructions\n\n"), dev)).otherwise(F.lit("")),
                     F.when((dev != "") & block.isNotNull(), F.lit("\n\n")).otherwise(F.lit("")),
                     F.coalesce(F.concat(F.lit("# Tools\n\n"), block), F.lit("")))
    return F.when(parts != "", F.concat(F.lit("<|start|>developer<|message|>"), parts, F.lit("<|end|>"))).otherwise(F.lit(""))


def render_chat(messages, add_generation_prompt: bool = True, reasoning_effort: str = DEFAULT_REASONING_EFFORT,
                date: str = "2025-01-01", has_thinking: bool = True, tools_block: Column | None = None,
                builtin: list[str] | None = None) -> Column:
    """Render messages to the channel-format prompt string.

    System preamble; a developer block from a first system/developer
    message and the tools (``tools.with_tools_block``); user turns; assistant
    turns (the last one, when no generation
    prompt follows, as thinking + final ending ``<|end|>``; earlier ones as
    thinking only when present, else final); later system messages are not
    rendered; optional ``<|start|>assistant`` generation prompt. Chats with tool
    calls, which this message schema has not, go through ``render_tool_chats``.
    """
    m = col(messages)
    first = F.get(m, 0)
    is_dev = F.coalesce(first["role"].isin("developer", "system"), F.lit(False))
    loop = F.when(is_dev, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    dev_block = developer_block(F.when(is_dev, first["content"]), tools_block)
    n = F.size(loop)

    def turn(x, i):
        thinking = x["thinking"] if has_thinking else F.lit(None).cast("string")
        content = F.coalesce(x["content"], F.lit(""))
        analysis = F.concat(F.lit("<|start|>assistant<|channel|>analysis<|message|>"), thinking, F.lit("<|end|>"))
        final = F.concat(F.lit("<|start|>assistant<|channel|>final<|message|>"), content, F.lit("<|end|>"))
        last = (i == n - 1) & F.lit(not add_generation_prompt)
        assistant = (F.when(last, F.concat(F.when(thinking.isNotNull(), analysis).otherwise(F.lit("")), final))
                     .when(thinking.isNotNull(), analysis).otherwise(final))
        return (F.when(x["role"] == "user", F.concat(F.lit("<|start|>user<|message|>"), content, F.lit("<|end|>")))
                .when(x["role"] == "assistant", assistant).otherwise(F.lit("")))

    body = F.array_join(F.transform(loop, turn), "")
    gen = F.lit("<|start|>assistant" if add_generation_prompt else "")
    return F.concat(system_block(date, reasoning_effort, builtin, tools_block), dev_block, body, gen)


def with_lengths(df: DataFrame, messages_col: str = "messages", date: str = "2025-01-01", count=count_tokens) -> DataFrame:
    """Per record: rendered prompt and its tokens, first assistant's content /
    thinking tokens (0 without assistant), completion and total tokens."""
    pm = prompt_messages(F.col(messages_col))
    d = df.withColumn("prompt", pm).withColumn("prompt_text", render_chat(F.col("prompt"), True, date=date, has_thinking=False))
    d = d.withColumn("_asst", first_by_role(F.col(messages_col), "assistant"))
    content = F.coalesce(F.col("_asst.content"), F.lit(""))
    thinking = F.coalesce(F.col("_asst.thinking"), F.lit(""))
    return (d.withColumn("has_assistant", F.col("_asst").isNotNull())
            .withColumn("prompt_tokens", count("prompt_text"))
            .withColumn("content_tokens", F.when(F.col("has_assistant"), count(content)).otherwise(F.lit(0)))
            .withColumn("thinking_tokens", F.when(F.col("has_assistant"), count(thinking)).otherwise(F.lit(0)))
            .withColumn("completion_tokens", F.col("content_tokens") + F.col("thinking_tokens"))
            .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
            .drop("_asst"))


def prepare_examples(df: DataFrame, limits: LengthLimits = LengthLimits(), messages_col: str = "messages",
                     db_cols: tuple = ("db_id", "database"), date: str = "2025-01-01",
                     keep_dropped: bool = False, count=count_tokens) -> DataFrame:
    """Filter records with one ``drop_reason`` (first reason wins, in the
    reference's order) and project prepared examples. Never truncates.

    Reasons: no_user_msg, prompt_too_long (> max prompt tokens),
    total_too_long (prompt + max completion > max sequence),
    completion_too_long (gold thinking + "\\n" + content tokens > max
    completion). Records without gold SQL are flagged, not dropped.
    """
    m = F.col(messages_col)
    d = df.withColumn("prompt", prompt_messages(m))
    d = d.withColumn("has_user", F.exists("prompt", lambda x: x["role"] == "user"))
    d = d.withColumn("prompt_text", render_chat(F.col("prompt"), True, date=date, has_thinking=False))
    d = d.withColumn("prompt_tokens", count("prompt_text"))
    d = d.withColumn("_asst", first_by_role(m, "assistant"))
    raw = F.coalesce(F.col("_asst.content"), F.lit(""))
    th = F.coalesce(F.col("_asst.thinking"), F.lit(""))
    d = (d.withColumn("gt_raw", raw).withColumn("ground_truth_thinking", th)
         .withColumn("gt_completion", F.concat(F.when(th != "", F.concat(th, F.lit("\n"))).otherwise(F.lit("")), raw))
         .withColumn("gt_completion_tokens", F.when(F.col("_asst").isNotNull(), count("gt_completion"))
                     .otherwise(F.lit(0))))
    reason = (F.when(~F.col("has_user"), "no_user_msg")
              .when(F.col("prompt_tokens") > limits.max_prompt_length, "prompt_too_long")
              .when(F.col("prompt_tokens") + limits.max_completion_length > limits.max_seq_length, "total_too_long")
              .when(F.col("_asst").isNotNull() & (F.col("gt_completion_tokens") > limits.max_completion_length),
                    "completion_too_long"))
    d = d.withColumn("drop_reason", reason)
    if not keep_dropped:
        d = d.where(F.col("drop_reason").isNull())
    d = P.add_gt_sql(d, "gt_raw", "ground_truth_sql")
    user = first_by_role(m, "user")
    fallbacks = [F.col(c) for c in db_cols if c in df.columns]
    dbn = P.extract_database_name(F.coalesce(user["content"], F.lit("")))
    d = d.withColumn("database_name", F.coalesce(F.when(dbn != "", dbn), *fallbacks, F.lit("")))
    d = d.withColumn("no_gt_sql", F.col("ground_truth_sql") == "")
    return d.drop("_asst", "has_user", "gt_raw", "gt_completion")


def filter_report(prepared_all: DataFrame) -> DataFrame:
    """Counts and percentages per drop reason (NULL reason = kept), over
    ``prepare_examples(..., keep_dropped=True)``."""
    r = F.coalesce(F.col("drop_reason"), F.lit("kept"))
    g = prepared_all.groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    # at most five reason rows: the total is a window over the tiny result
    total = F.sum("n").over(Window.partitionBy())
    return g.select("reason", "n", (100.0 * F.col("n") / F.greatest(total, F.lit(1))).alias("pct"))


def truncation_report(lengths: DataFrame, limits: LengthLimits = LengthLimits()) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return lengths.agg(
        F.count_if(F.col("prompt_tokens") > limits.max_prompt_length).alias("n_prompt_over"),
        (100.0 * F.count_if(F.col("prompt_tokens") > limits.max_prompt_length) / n).alias("pct_prompt_over"),
        F.count_if(F.col("has_assistant") & (F.col("completion_tokens") > limits.max_completion_length))
        .alias("n_completion_over"),
        (100.0 * F.count_if(F.col("has_assistant") & (F.col("completion_tokens") > limits.max_completion_length)) / n)
        .alias("pct_completion_over"))


def token_stats(lengths: DataFrame) -> DataFrame:
    """min/max/mean/median/population std/P90/P95/P99 (linear interpolation)
    per length series; completion-side series only over records with an
    assistant message; every series has a row. Lengths are counted first
    (map-side); all statistics, the quantiles by rank, come from these counts,
    in whole numbers as far as possible."""
    spark = lengths.sparkSession
    told = F.col("has_assistant")
    series = {"prompt": F.col("prompt_tokens"), "completion": F.when(told, F.col("completion_tokens")),
              "thinking": F.when(told, F.col("thinking_tokens")), "sql": F.when(told, F.col("content_tokens")), "total": F.col("total_tokens")}
    long = lengths.select(F.explode(F.array(*[F.struct(F.lit(k).alias("series"), v.cast("bigint").alias("v")) for k, v in series.items()])).alias("x")).select("x.*")
    counted = counted_values(long, ["series"], "v")
    v, n = F.col("v").cast("decimal(19,0)"), F.col("_n").cast("decimal(19,0)")
    sums = counted.groupBy("series").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.sum("_n").alias("n"),
                                         F.sum((v * n).cast("decimal(38,0)")).alias("s"), F.sum((v * v * n).cast("decimal(38,0)")).alias("ss"))
    spread = F.sqrt(F.greatest((F.col("ss") * F.col("n") - F.col("s") * F.col("s")).cast("double"), F.lit(0.0))) / F.col("n")
    at = quantiles(counted, ["series"], "v", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    names = spark.createDataFrame([(k,) for k in series], "series string")  # five rows
    return F.broadcast(names).join(sums, "series", "left").join(at, "series", "left").select(
        "series", "min", "max", (F.col("s").cast("double") / F.col("n")).alias("mean"), spread.alias("std"),
        F.coalesce("n", F.lit(0)).alias("n"), "median", "p90", "p95", "p99")


def length_histogram(lengths: DataFrame, col_name: str = "prompt_tokens") -> DataFrame:
    """Half-open bins; every bin is reported, empty ones with 0. The bin
    table has a fixed 8 rows, so it is broadcast."""
    spark = lengths.sparkSession
    edges = LENGTH_BINS
    bins = spark.createDataFrame([(i, edges[i], edges[i + 1] if i + 1 < len(edges) else None)
                                  for i in range(len(edges))], "bin int, lo int, hi int")
    v = F.col(col_name)
    idx = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        idx = F.when(v < edges[i + 1], F.lit(i)).otherwise(idx)
    counts = lengths.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def tool_turns(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               tool_col: str = "tool_name") -> DataFrame:
    """Context of tool calls, per turn row: ``later_answer`` (a later assistant
    turn without a tool call), ``last_tool`` (name of the last tool call
    before or at the turn, forgotten after an assistant turn without one),
    ``first_turn`` and ``last_turn``."""
    w = Window.partitionBy(conv_col).orderBy(turn_col)
    answer = (F.col(role_col) == "assistant") & F.col(tool_col).isNull()
    after = w.rowsBetween(1, Window.unboundedFollowing)
    d = convs.withColumn("later_answer", F.coalesce(F.max(answer).over(after), F.lit(False)))
    before = F.coalesce(F.sum(answer.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_span", before).withColumn("first_turn", F.lag(F.lit(1)).over(w).isNull()) \
        .withColumn("last_turn", F.lead(F.lit(1)).over(w).isNull())
    inside = Window.partitionBy(conv_col, "_span").orderBy(turn_col).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("last_tool", F.last(tool_col, ignorenulls=True).over(inside)).drop("_span")


def chat_lint(turns: DataFrame, conv_col: str = "conv_id", role_col: str = "role", content_col: str = "text",
              thinking_col: str = "thinking", tool_col: str = "tool_name") -> DataFrame:
    """Conversations that a chat template would reject, from ``tool_turns``
    rows: channel tags inside thinking; thinking and content beside a tool call;
    a tool result without an earlier call. One row a conversation with the
    number of each fault and ``ok``."""
    call = (F.col(role_col) == "assistant") & F.col(tool_col).isNotNull()
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    tags = F.coalesce(F.col(thinking_col), F.lit("")).rlike(r"<\|channel\|>(?:analysis|final)<\|message\|>")
    d = turns.groupBy(conv_col).agg(
        F.count_if((F.col(role_col) == "assistant") & tags).alias("n_channel_tags"),
        F.count_if(call & has(content_col) & has(thinking_col)).alias("n_both_with_call"),
        F.count_if((F.col(role_col) == "tool") & F.col("last_tool").isNull()).alias("n_result_without_call"))
    return d.withColumn("ok", (F.col("n_channel_tags") == 0) & (F.col("n_both_with_call") == 0) & (F.col("n_result_without_call") == 0))


def render_turn(role: str = "role", content: str = "text", thinking: str = "thinking", tool: str = "tool_name",
                arguments: str = "arguments", content_type: str = "content_type", add_generation_prompt: bool = True) -> Column:
    """One rendered turn of a ``tool_turns`` row.

    A call: its content, or else its thinking, as analysis unless a later answer
    exists; then the arguments (text as it is, other types as JSON). An
    assistant turn without a call: its thinking alone where the column is not
    NULL, else its content as final; both on the last turn when no generation
    prompt follows. A result goes by the name of the last call. A first
    system/developer turn and later system turns render as nothing here."""
    r, c = F.col(role), F.coalesce(F.col(content), F.lit(""))
    th = F.col(thinking)

    def analysis(x: Column) -> Column:
        return F.concat(F.lit("<|start|>assistant<|channel|>analysis<|message|>"), x, F.lit("<|end|>"))

    beside = F.when(F.col("later_answer"), F.lit("")).when(c != "", analysis(c)) \
        .when(F.coalesce(th, F.lit("")) != "", analysis(th)).otherwise(F.lit(""))
    call = F.concat(beside, F.lit("<|start|>assistant to=functions."), F.col(tool), F.lit("<|channel|>commentary "),
                    F.coalesce(F.col(content_type), F.lit("json")), F.lit("<|message|>"), F.coalesce(F.col(arguments), F.lit("")), F.lit("<|call|>"))
    result = F.concat(F.lit("<|start|>functions."), F.coalesce(F.col("last_tool"), F.lit("")),
                      F.lit(" to=assistant<|channel|>commentary<|message|>"), c, F.lit("<|end|>"))
    final = F.concat(F.lit("<|start|>assistant<|channel|>final<|message|>"), c, F.lit("<|end|>"))
    shut = F.concat(F.when(th.isNotNull(), analysis(th)).otherwise(F.lit("")), final)
    plain = F.when(th.isNotNull(), analysis(th)).otherwise(final)
    if not add_generation_prompt:
        plain = F.when(F.col("last_turn"), shut).otherwise(plain)
    return (F.when(r == "user", F.concat(F.lit("<|start|>user<|message|>"), c, F.lit("<|end|>")))
            .when((r == "assistant") & F.col(tool).isNotNull(), call).when(r == "tool", result)
            .when(r == "assistant", plain).otherwise(F.lit("")))


def arguments_text(df: DataFrame, arguments: str = "arguments") -> Column:
    """Call arguments as text: strings as they are, other types as spaced JSON."""
    return F.col(arguments) if dict(df.dtypes)[arguments] == "string" else T.spaced_json(F.to_json(F.col(arguments)))


def render_tool_chats(turns: DataFrame, tools: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                      tools_col: str = "tools", date: str = "2025-01-01", reasoning_effort: str = DEFAULT_REASONING_EFFORT,
                      builtin: list[str] | None = None, add_generation_prompt: bool = True) -> DataFrame:
    """(conv, rendered) of whole conversations from ``tool_turns`` rows
    (role, text, thinking, tool_name, arguments, content_type). ``tools`` holds
    each conversation's tool list as JSON text; it need not hold every conversation."""
    d = turns.withColumn("arguments", arguments_text(turns))
    d = d.withColumn("_r", render_turn(add_generation_prompt=add_generation_prompt))
    first = F.col("first_turn") & F.col("role").isin("developer", "system")
    chats = d.groupBy(conv_col).agg(  # one conversation's turns
        F.array_sort(F.collect_list(F.struct(turn_col, "_r"))).alias("_t"), F.max(F.when(first, F.col("text"))).alias("_dev"))
    block = F.lit(None).cast("string")
    if tools is not None:
        made = T.with_tools_block(tools.select(conv_col, tools_col), tools_col, "_block").select(conv_col, "_block")
        chats, block = chats.join(made, conv_col, "left"), F.col("_block")
    return chats.select(conv_col, F.concat(
        system_block(date, reasoning_effort, builtin, block), developer_block(F.col("_dev"), block),
        F.array_join(F.transform("_t", lambda x: x["_r"]), ""), F.lit("<|start|>assistant" if add_generation_prompt else "")).alias("rendered"))


def length_budget(lengths: DataFrame, max_seq_length: int) -> DataFrame:
    """``max_prompt = max(prompt tokens) + 1``, completion budget = rest."""
    return lengths.agg((F.max("prompt_tokens") + 1).alias("max_prompt_length")).withColumn(
        "max_completion_length", F.lit(max_seq_length) - F.col("max_prompt_length"))


def text_profile(df: DataFrame, text_col: str, preview: int = 100) -> DataFrame:
    t = F.col(text_col)
    return df.withColumn("n_chars", F.length(t)).withColumn("n_words", F.size(py_words(t))) \
        .withColumn("preview", F.replace(F.substr(t, F.lit(1), F.lit(preview)), F.lit("\n"), F.lit(" ")))


def token_head(df: DataFrame, text_col: str, k: int = 50) -> DataFrame:
    """First k tokens (native rule) with 0-based position."""
    toks = F.slice(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN_RE), 0), 1, k)
    return df.select("*", F.posexplode(toks).alias("pos", "token"))
