"""Tool definitions and tool turns: expected strings written by hand from the template's rules."""

import json

import pytest
from pyspark.sql import functions as F

from rollcall.operators import prepare as P
from rollcall.operators import tools as T

TURN = ("conv_id int, turn int, role string, text string, thinking string, tool_name string, arguments string, content_type string")
A, FIN = "<|start|>assistant<|channel|>analysis<|message|>", "<|start|>assistant<|channel|>final<|message|>"


def rendered(spark, turns, **options):
    """One conversation: (role, text, thinking, tool, arguments, content type) rows."""
    rows = [(1, i, *(list(t) + [None] * 6)[:6]) for i, t in enumerate(turns)]
    d = P.tool_turns(spark.createDataFrame(rows, TURN))
    return [r.x for r in d.withColumn("x", P.render_turn(**options)).orderBy("turn").collect()]


def test_a_call_shows_what_stands_beside_it_only_without_a_later_answer(spark):
    call = "<|start|>assistant to=functions.f<|channel|>commentary json<|message|>{\"a\": 1}<|call|>"
    args = '{"a": 1}'
    assert rendered(spark, [("user", "q"), ("assistant", "why", None, "f", args)])[1] == A + "why<|end|>" + call
    assert rendered(spark, [("user", "q"), ("assistant", "", "hm", "f", args)])[1] == A + "hm<|end|>" + call
    assert rendered(spark, [("user", "q"), ("assistant", None, None, "f", args)])[1] == call
    assert rendered(spark, [("user", "q"), ("assistant", "why", None, "f", args), ("assistant", "done")])[1] == call
    assert rendered(spark, [("user", "q"), ("assistant", None, "hm", "f", args), ("assistant", "done")])[1] == call
    # a later call is no answer
    assert rendered(spark, [("assistant", "why", None, "f", args), ("assistant", None, None, "g", "{}")])[0] == A + "why<|end|>" + call


def test_content_type_and_text_arguments(spark):
    assert rendered(spark, [("assistant", None, None, "py", "1 + 1", "code")]) == \
        ["<|start|>assistant to=functions.py<|channel|>commentary code<|message|>1 + 1<|call|>"]


def test_results_go_by_the_last_call(spark):
    out = rendered(spark, [("assistant", None, None, "f", "{}"), ("tool", "r1"), ("user", "u"), ("tool", "r2"), ("assistant", "x"), ("tool", "r3")])
    assert out[1] == "<|start|>functions.f to=assistant<|channel|>commentary<|message|>r1<|end|>"
    assert out[2] == "<|start|>user<|message|>u<|end|>"
    assert out[3] == "<|start|>functions.f to=assistant<|channel|>commentary<|message|>r2<|end|>"
    assert out[5] == "<|start|>functions. to=assistant<|channel|>commentary<|message|>r3<|end|>"  # chat_lint reports it


def test_plain_answers(spark):
    turns = [("user", "q"), ("assistant", "a1", "t1"), ("assistant", "a2"), ("system", "s"), ("assistant", "a3", "t3")]
    assert rendered(spark, turns) == ["<|start|>user<|message|>q<|end|>", A + "t1<|end|>", FIN + "a2<|end|>", "", A + "t3<|end|>"]
    assert rendered(spark, turns, add_generation_prompt=False)[-1] == A + "t3<|end|>" + FIN + "a3<|end|>"
    assert rendered(spark, [("assistant", "a")], add_generation_prompt=False) == [FIN + "a<|end|>"]
    # an empty thinking is given, so it is rendered
    assert rendered(spark, [("assistant", "a", "")]) == [A + "<|end|>"]


def test_whole_chat_with_tools(spark):
    turns = spark.createDataFrame([
        (1, 0, "system", "Be brief.", None, None, None, None), (1, 1, "user", "time?", None, None, None, None),
        (1, 2, "assistant", None, None, "now", "{}", None), (1, 3, "tool", "noon", None, None, None, None),
        (2, 0, "user", "hi", None, None, None, None), (2, 1, "system", "late", None, None, None, None)], TURN)
    lists = spark.createDataFrame([(1, json.dumps([{"type": "function", "function": {"name": "now", "description": "Time."}}]))], "conv_id int, tools string")
    got = {r.conv_id: r.rendered for r in P.render_tool_chats(P.tool_turns(turns), lists, date="2025-02-03", builtin=["python"]).collect()}
    system = ("<|start|>system<|message|>You are ChatGPT, a large language model trained by OpenAI.\nKnowledge cutoff: 2024-06\nCurrent date: 2025-02-03\n\n"
              "Reasoning: medium\n\n# Tools\n\n" + T.PYTHON + "# Valid channels: analysis, commentary, final. Channel must be included for every message.")
    assert got[1] == (system + "\nCalls to these tools must go to the commentary channel: 'functions'.<|end|>"
                      "<|start|>developer<|message|># Instructions\n\nBe brief.\n\n# Tools\n\n## functions\n\nnamespace functions {\n\n"
                      "// Time.\ntype now = () => any;\n\n} // namespace functions<|end|>"
                      "<|start|>user<|message|>time?<|end|><|start|>assistant to=functions.now<|channel|>commentary json<|message|>{}<|call|>"
                      "<|start|>functions.now to=assistant<|channel|>commentary<|message|>noon<|end|><|start|>assistant")
    assert got[2] == system + "<|end|><|start|>user<|message|>hi<|end|><|start|>assistant"


def test_arguments_of_other_types_become_json(spark):
    d = spark.createDataFrame([(1, 0, "assistant", None, None, "f", {"a": "x, y:z", "b": "1"}, None)],
                              TURN.replace("arguments string", "arguments map<string,string>"))
    assert P.render_tool_chats(P.tool_turns(d)).first().rendered.endswith(
        '<|start|>assistant to=functions.f<|channel|>commentary json<|message|>{"a": "x, y:z", "b": "1"}<|call|><|start|>assistant')


GAP = ": \n" + " " * 16
TYPES = [
    ({"type": "string"}, "string"), ({"type": "string", "nullable": True}, "string | null"), ({"type": "integer", "nullable": True}, "number"),
    ({"type": "number"}, "number"), ({"type": "boolean"}, "boolean"), ({"type": "object"}, "object"), ({}, "any"), ({"type": "file"}, "any"),
    ({"type": "string", "enum": ["a", "b c"], "nullable": True}, '"a" | "b c"'), ({"type": "string", "enum": []}, "string"),
    ({"type": "array"}, "any[]"), ({"type": "array", "items": {}, "nullable": True}, "any[] | null"),
    ({"type": "array", "items": {"type": "string"}}, "string[]"), ({"type": "array", "items": {"type": "integer"}, "nullable": True}, "number[] | null"),
    ({"type": "array", "items": {"type": "array", "items": {"type": "array", "items": {"type": "boolean"}}}}, "boolean[][][]"),
    ({"type": "array", "items": {"type": ["object", "object"]}}, "any[]"), ({"type": "array", "items": {"type": ["string", "null"]}}, "string | null[]"),
    ({"type": ["object", "object"]}, "object | object"), ({"type": ["string"]}, "string"), ({"type": []}, "any"),
    ({"oneOf": [{"type": "object"}]}, "object"), ({"oneOf": [{"type": "object"}, {"type": "string"}]}, "any"),
    ({"type": "string", "oneOf": [{"type": "integer"}, {"type": "boolean", "description": "flag"}]}, "number | \nboolean// flag"),
    ({"oneOf": [{"type": "string", "default": None}]}, "string" + " " * 20 + "// default: null"),
    ({"type": "object", "required": ["y"], "properties": {"y": {"type": "string"}, "x": {"type": "object", "properties": {"k": {"type": "array", "items": {"type": "string"}}}}}},
     "{\ny" + GAP + "string, x?" + GAP + "{\nk?" + GAP + "string[]}}"),
    ({"type": "array", "items": {"type": "object", "properties": {"very_long_property_name": {"type": "string"}}}}, "any[]"),
    ({"type": "array", "items": {"type": "object", "properties": {"p": {"type": "string"}}}}, "{\np?" + GAP + "string}[]"),
]


def test_types_of_schemas(spark):
    rows = [(json.dumps(s), t) for s, t in TYPES]
    got = {r.json: r.text for r in T.schema_types(spark.createDataFrame(rows, "json string, t string")).collect()}
    for schema, text in rows:
        assert got[schema] == text, schema


def test_ten_levels(spark):
    spec, text = {"type": "string"}, "string"
    for k in range(10):
        spec, text = {"type": "object", "properties": {f"p{k}": spec}}, "{\n" + f"p{k}?" + GAP + text + "}"
    assert T.schema_types(spark.createDataFrame([(json.dumps(spec),)], "json string")).where(F.col("json") == json.dumps(spec)).first().text == text


@pytest.mark.parametrize("value,text", [("x", '"x"'), (5, "5"), (0.5, "0.5"), (True, "true"), (None, "null"), (["a,b", 1], '["a,b", 1]'),
                                        ({"z": {"q": '"'}, "a": []}, '{"z": {"q": "\\""}, "a": []}'), ("é: ü, \"q\"", '"é: ü, \\"q\\""')])
def test_defaults_as_json(spark, value, text):
    tools = json.dumps([{"function": {"name": "f", "description": "d", "parameters": {"properties": {"p": {"type": "string", "default": value}}}}}], ensure_ascii=False)
    block = T.tool_namespaces(spark.createDataFrame([(tools,)], "tools string")).first().block
    assert f"p?: string, // default: {text},\n" in block


def test_odd_lists(spark):
    rows = [(1, None), (2, ""), (3, "[]"), (4, "{"), (5, "7"), (6, json.dumps([{}])), (6, json.dumps([{}]))]
    got = sorted((r.id, r.tools_block) for r in T.with_tools_block(spark.createDataFrame(rows, "id int, tools string")).collect())
    empty = "## functions\n\nnamespace functions {\n\n// \ntype  = () => any;\n\n} // namespace functions"
    assert got == [(1, None), (2, None), (3, None), (4, None), (5, None), (6, empty), (6, empty)]
    assert T.with_tools_block(spark.createDataFrame([], "id int, tools string")).count() == 0
