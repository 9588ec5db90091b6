"""Tool definitions of a chat as a typed namespace, rendered with Spark.

Tool lists are JSON texts. Every distinct list is rendered once and joined back.
The parameters' JSON schemas are nested, so their types are built in two sweeps
over distinct schema texts: downwards, level by level, each level holds the
distinct schemas that the one above refers to (array items, variants,
properties), until a level is empty; upwards, each level joins the types of the
one below. A schema is shorter than any that holds it, so the sweeps end, and
equal schemas anywhere are rendered once. Levels are written to the shared folder.

Defined results: a null, empty or unreadable tool list gives NULL; a tool
without parameters takes none; a schema that cannot be read is ``any``; a null
name or description is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

# --- fixed values: layout of the tools text --------------------------------------
CALLS_LINE = "\nCalls to these tools must go to the commentary channel: 'functions'."
INDENT = "\n" + " " * 16          # before the type of an object's property
DEFAULT_INDENT = " " * 20         # before the default of a variant
LONGEST_ITEM = 50                 # longer item types become any[]
BROWSER = """## browser

// Tool for browsing.
// The `cursor` appears in brackets before each browsing display: `[{cursor}]`.
// Cite information from the tool using the following format:
// `【{cursor}†L{line_start}(-L{line_end})?】`, for example: `【6†L9-L11】` or `【8†L3】`.
// Do not quote more than 10 words directly from the tool output.
// sources=web (default: web)
namespace browser {

// Searches for information related to `query` and displays `topn` results.
type search = (_: {
query: string,
topn?: number, // default: 10
source?: string,
}) => any;

// Opens the link `id` from the page indicated by `cursor` starting at line number `loc`, showing `num_lines` lines.
// Valid link ids are displayed with the formatting: `【{id}†.*】`.
// If `cursor` is not provided, the most recent page is implied.
// If `id` is a string, it is treated as a fully qualified URL associated with `source`.
// If `loc` is not provided, the viewport will be positioned at the beginning of the document or centered on the most relevant passage, if available.
// Use this function without `id` to scroll to a new location of an opened page.
type open = (_: {
id?: number | string, // default: -1
cursor?: number, // default: -1
loc?: number, // default: -1
num_lines?: number, // default: -1
view_source?: boolean, // default: false
source?: string,
}) => any;

// Finds exact matches of `pattern` in the current page, or the page given by `cursor`.
type find = (_: {
pattern: string,
cursor?: number, // default: -1
}) => any;

} // namespace browser

"""
PYTHON = """## python

Use this tool to execute Python code in your chain of thought. The code will not be shown to the user. This tool should be used for internal reasoning, but not for code that is intended to be visible to the user (e.g. when creating plots, tables, or files).

When you send a message containing Python code to python, it will be executed in a stateful Jupyter notebook environment. python will respond with the output of the execution or time out after 120.0 seconds. The drive at '/mnt/data' can be used to save and persist user files. Internet access for this session is UNKNOWN. Depends on the cluster.

"""
BUILTIN = {"browser": BROWSER, "python": PYTHON}
# --- end fixed values --------------------------------------------------------------

_SCHEMA = ("type STRING, items STRING, nullable BOOLEAN, oneOf ARRAY<STRING>, enum ARRAY<STRING>, description STRING, "
           "default VARIANT, properties MAP<STRING, STRING>, required ARRAY<STRING>")
_TOOL = "function STRUCT<name: STRING, description: STRING, parameters: STRING>"


def builtin_tools(names: list[str]) -> str:
    """The text of the built-in tools, browser first."""
    return "".join(text for name, text in BUILTIN.items() if name in names)


def spaced_json(compact: Column) -> Column:
    """Compact JSON with a blank after each comma and colon outside strings."""
    tokens = F.regexp_extract_all(compact, F.lit(r'"(?:[^"\\]|\\.)*+"|[^",:]+|[,:]'), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), "")


def _truthy(text: Column) -> Column:
    """A JSON value, as text, that counts as given: not empty, zero, false or null."""
    return F.coalesce(~text.isin("", "{}", "[]", "null", "false", "0"), F.lit(False))


def _filled(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def _described(schemas: DataFrame) -> DataFrame:
    """(json) -> (json, kind, fields, children): what a schema is and refers to.
    The first matching kind counts, in this order."""
    d = schemas.withColumn("s", F.from_json("json", _SCHEMA))
    kind_of = F.coalesce(F.col("s.type"), F.lit(""))
    item = F.get_json_object("s.items", "$.type")
    variants = F.coalesce(F.col("s.oneOf"), F.array().cast("array<string>"))
    objects = F.exists(variants, lambda v: F.coalesce(F.get_json_object(v, "$.type") == "object", F.lit(False)))
    kind = (F.when(kind_of == "array", F.when(~_truthy(F.col("s.items")), "any items")
                   .when(item.isin("string", "boolean"), "plain items").when(item.isin("number", "integer"), "number items").otherwise("items"))
            .when(kind_of.startswith("[") & (kind_of != "[]"), "types")
            .when(_filled(variants), F.when(objects & (F.size(variants) > 1), "any").otherwise("variants"))
            .when((kind_of == "string") & _filled(F.col("s.enum")), "enum").when(kind_of == "string", "string")
            .when(kind_of.isin("number", "integer"), "number").when(kind_of == "boolean", "boolean")
            .when(kind_of == "object", F.when(_filled(F.map_keys("s.properties")), "object").otherwise("plain object"))
            .otherwise("any"))
    d = d.withColumn("kind", kind).withColumn("item", item)
    child = lambda name, json: F.struct(name.alias("name"), json.alias("json"))
    none = F.lit(None).cast("string")
    children = (F.when(F.col("kind") == "items", F.array(child(none, F.col("s.items"))))
                .when(F.col("kind") == "variants", F.transform(F.col("s.oneOf"), lambda v: child(none, v)))
                .when(F.col("kind") == "object", F.transform(F.map_entries("s.properties"), lambda e: child(e["key"], e["value"])))
                .otherwise(F.array().cast("array<struct<name: string, json: string>>")))
    return d.select("json", "kind", "item", F.coalesce("s.nullable", F.lit(False)).alias("nullable"), F.col("s.type").alias("type"),
                    F.col("s.enum").alias("enum"), F.coalesce("s.required", F.array().cast("array<string>")).alias("required"), children.alias("children"))


def _with_default(json: str) -> list[Column]:
    """description, has_default and the default as JSON, of a schema text. The
    variant tells a string (quoted) from other values (as written, keys in order)."""
    s = F.from_json(json, _SCHEMA)
    has = F.coalesce(F.array_contains(F.json_object_keys(json), "default"), F.lit(False))
    text = F.when(F.schema_of_variant(s["default"]) == "STRING", F.to_json(s["default"])).otherwise(spaced_json(F.get_json_object(json, "$.default")))
    return [s["description"].alias("description"), has.alias("has_default"), F.coalesce(text, F.lit("null")).alias("default")]


def _text(kids: Column) -> Column:
    """The type of a described schema, ``kids`` being its children with their types."""
    k = F.col("kind")
    or_null = F.when(F.col("nullable"), F.lit(" | null")).otherwise(F.lit(""))
    inner = F.get(kids, 0)["text"]
    listed = F.from_json("type", "array<string>")

    def variant(x: Column, i: Column) -> Column:
        return F.concat(x["text"], F.when(F.coalesce(x["description"], F.lit("")) != "", F.concat(F.lit("// "), x["description"])).otherwise(F.lit("")),
                        F.when(x["has_default"], F.concat(F.lit(DEFAULT_INDENT + "// default: "), x["default"])).otherwise(F.lit("")),
                        F.when(i < F.size(kids) - 1, F.lit(" | \n")).otherwise(F.lit("")))

    def member(x: Column) -> Column:
        return F.concat(x["name"], F.when(F.array_contains("required", x["name"]), F.lit("")).otherwise(F.lit("?")), F.lit(": " + INDENT), x["text"])

    return (F.when(k == "any items", F.concat(F.lit("any[]"), or_null)).when(k == "plain items", F.concat("item", F.lit("[]"), or_null))
            .when(k == "number items", F.concat(F.lit("number[]"), or_null))
            .when(k == "items", F.concat(F.when((inner == "object | object") | (F.length(inner) > LONGEST_ITEM), F.lit("any")).otherwise(inner), F.lit("[]"), or_null))
            .when(k == "types", F.array_join(listed, " | "))
            .when(k == "variants", F.array_join(F.transform(kids, variant), ""))
            .when(k == "enum", F.concat(F.lit('"'), F.array_join("enum", '" | "'), F.lit('"')))
            .when(k == "string", F.concat(F.lit("string"), or_null)).when(k.isin("number", "boolean"), k)
            .when(k == "object", F.concat(F.lit("{\n"), F.array_join(F.transform(kids, member), ", "), F.lit("}")))
            .when(k == "plain object", F.lit("object")).otherwise(F.lit("any")))


def schema_types(schemas: DataFrame) -> DataFrame:
    """(json, text): the type of every distinct JSON schema text in column ``json``."""
    levels, level = [], _described(schemas.select("json").where("json is not null").distinct())
    while True:
        level = staged(level, "schema-level")
        if not level.head(1):
            break
        levels.append(level)
        below = level.select(F.explode("children").alias("c")).select("c.json").where("json is not null").distinct()
        level = _described(below)
    types = schemas.sparkSession.createDataFrame([], "json string, text string")
    for level in reversed(levels):
        kid = level.select(F.col("json").alias("of"), F.posexplode("children").alias("at", "c")).select("of", "at", "c.*") \
            .join(types, "json", "left").select("of", "at", "name", F.coalesce("text", F.lit("any")).alias("text"), *_with_default("json"))
        kids = kid.groupBy("of").agg(F.array_sort(F.collect_list(F.struct(
            "at", "name", "text", "description", "has_default", "default"))).alias("kids"))  # bounded by one schema's text
        types = staged(level.join(kids, level["json"] == kids["of"], "left").select("json", _text(F.col("kids")).alias("text")), "schema-types")
    return types


def tool_namespaces(lists: DataFrame, tools_col: str = "tools", namespace: str = "functions") -> DataFrame:
    """(tools, block): every distinct tool list with its rendered namespace."""
    tool = lists.select(F.col(tools_col).alias("tools")).where(F.col(tools_col).isNotNull()).distinct() \
        .withColumn("list", F.from_json("tools", "array<string>")).where("size(list) > 0") \
        .select("tools", F.posexplode("list").alias("tool", "json")).select("tools", "tool", F.from_json("json", _TOOL)["function"].alias("f")) \
        .withColumn("p", F.from_json("f.parameters", "properties MAP<STRING, STRING>, required ARRAY<STRING>"))
    tool = staged(tool.select("tools", "tool", F.coalesce("f.name", F.lit("")).alias("name"), F.coalesce("f.description", F.lit("")).alias("description"),
                               F.map_entries("p.properties").alias("entries"), F.coalesce("p.required", F.array().cast("array<string>")).alias("required")), "tools")
    param = tool.select("tools", "tool", "required", F.posexplode("entries").alias("at", "e")).select(
        "tools", "tool", "required", "at", F.col("e.key").alias("param"), F.col("e.value").alias("json"))
    param = param.join(schema_types(param.select("json")), "json", "left").select(
        "*", *_with_default("json"), F.from_json("json", _SCHEMA).alias("s"))
    plain = F.coalesce(F.try_variant_get("s.default", "$", "string"), F.lit("null"))
    given = F.when(~F.col("has_default"), F.lit("")).when(_filled(F.col("s.enum")), F.concat(F.lit(", // default: "), plain)) \
        .when(_filled(F.col("s.oneOf")), F.concat(F.lit("// default: "), plain)).otherwise(F.concat(F.lit(", // default: "), F.col("default")))
    line = F.concat(F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("// "), "description", F.lit("\n"))).otherwise(F.lit("")),
                    "param", F.when(F.array_contains("required", F.col("param")), F.lit("")).otherwise(F.lit("?")), F.lit(": "),
                    F.coalesce("text", F.lit("any")), given, F.lit(",\n"))
    args = param.select("tools", "tool", "at", line.alias("line")).groupBy("tools", "tool").agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    args = args.select("tools", "tool", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("args"))
    one = F.concat(F.lit("// "), "description", F.lit("\ntype "), "name", F.lit(" = "),
                   F.when(F.col("args").isNull(), F.lit("() => any;\n\n")).otherwise(F.concat(F.lit("(_: {\n"), "args", F.lit("}) => any;\n\n"))))
    rendered = tool.join(args, ["tools", "tool"], "left").select("tools", "tool", one.alias("text"))
    block = rendered.groupBy("tools").agg(F.array_sort(F.collect_list(F.struct("tool", "text"))).alias("t"))
    return block.select("tools", F.concat(F.lit(f"## {namespace}\n\nnamespace {namespace} {{\n\n"),
                                          F.array_join(F.transform("t", lambda x: x["text"]), ""), F.lit(f"}} // namespace {namespace}")).alias("block"))


def with_tools_block(df: DataFrame, tools_col: str = "tools", out: str = "tools_block") -> DataFrame:
    """Adds the rendered namespace of each row's tool list (NULL without tools)."""
    made = tool_namespaces(df, tools_col).select(F.col("tools").alias("_tools"), F.col("block").alias(out))
    return df.join(made, F.col(tools_col) == F.col("_tools"), "left").drop("_tools")
