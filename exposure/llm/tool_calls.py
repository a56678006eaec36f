"""Tool calls in chats, in DataFrame operations only: calls are linked to results, ordered, validated and serialised.

* Calls and results are joined by (conv_id, call_id), a hash join. A call may have several results; the earliest counts and
  their number is told. A result without a call is returned as an orphan.
* A call may need others of its conversation. Calls are peeled off in rounds, those whose needs are all peeled off first; the
  round is the call's ``level``, and (level, position, call_id) is an order in which every call follows what it needs. Only
  calls with needs take part, and each round leaves the join what is still open, so there are as many rounds as the longest
  chain has calls. Calls on a cycle, or behind one, are left when a round peels off nothing; they have no level and are
  last. A need that names no call of the conversation is an error of the call and doesn't hold it up.
* Arguments are checked against the tool's schema: JSON object, known tool, required fields, known fields, types.
* Each call becomes one line of canonical JSON: keys in order, no white space, nested values likewise.

A null call_id links with nothing: such calls and results stand alone. Repeated calls (same conversation and id) are kept
as rows of their own, each with an error that says so. Null arguments are invalid JSON; null texts are null in JSON. Empty
tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure.llm.shared import stored

#: JSON types a schema may ask for, and how the type of a parsed value begins.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)"}


def schema_table(spark: SparkSession, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """tool, fields: one row per tool from ``{tool: {field: (type, required)}}``."""

    def field(name: str, kind: str, required: bool) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"), F.lit(TYPES[kind]).alias("pattern"), F.lit(required).alias("required"))

    tools = [F.struct(F.lit(tool).alias("tool"), F.array(*(field(f, *spec) for f, spec in sorted(fields.items()))).alias("fields")) for tool, fields in schemas.items()]
    return spark.range(1).select(F.explode(F.array(*tools)).alias("t")).select("t.*")


def argument_errors(arguments: Column, fields: Column) -> Column:
    """What is wrong with JSON arguments by the fields of a schema, in order; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    values = F.when(kind.startswith("OBJECT"), parsed.cast("map<string,variant>"))
    names = F.transform(fields, lambda f: f["field"])
    given = lambda f: F.element_at(values, f["field"])
    present = lambda f: F.array_contains(F.map_keys(values), f["field"])
    of_field = lambda f: F.when(~present(f), F.when(f["required"], F.concat(F.lit("missing "), f["field"]))).when(
        ~F.coalesce(F.regexp(F.schema_of_variant(given(f)), F.concat(F.lit("^"), f["pattern"])), F.lit(False)), F.concat(f["field"], F.lit(" is not "), f["type"])
    )
    unknown = F.transform(F.array_except(F.map_keys(values), names), lambda k: F.concat(F.lit("unknown "), k))
    found = F.concat(F.transform(fields, of_field), unknown)
    return F.when(values.isNull(), F.array(F.lit("arguments are not a JSON object"))).when(fields.isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.filter(found, lambda e: e.isNotNull())))


def canonical(json: Column) -> Column:
    """JSON text with keys in order and no white space; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that need others: 1 and up, null on a cycle or behind one. ``calls``: conv_id,
    call_id, needs (array of call_ids)."""
    known = calls.select("conv_id", "call_id").where("call_id is not null").distinct()
    needs = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).where("call_id is not null and need is not null").distinct()
    open_ = stored(needs.join(known.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi"), "needs")
    done, level = None, 1
    left = open_.count()
    while left:
        waiting = open_.select("conv_id", F.col("call_id").alias("need")).distinct()
        # Needs that wait for others themselves stay; a call all of whose needs are gone has this level.
        still = stored(open_.join(waiting, ["conv_id", "need"], "left_semi").select("conv_id", "call_id", "need"), "needs")
        peeled = open_.select("conv_id", "call_id").distinct().join(still.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
        peeled = stored(peeled.withColumn("level", F.lit(level)), "level")
        done = peeled if done is None else done.union(peeled)
        if not peeled.limit(1).count():
            done = done.union(still.select("conv_id", "call_id").distinct().withColumn("level", F.lit(None).cast("int")))
            break
        open_, left, level = still, still.count(), level + 1
    return done if done is not None else known.where("false").withColumn("level", F.lit(None).cast("int"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without a call.

    ``calls``: conv_id, position, call_id, tool, arguments (JSON), needs (array of call_ids); ``results``: conv_id,
    position, call_id, content; ``schemas`` as ``schema_table`` gives it. Columns: conv_id, kind ("call" or "orphan"),
    call_id, position, level, ord (place in the conversation's order, from 0), tool, n_results, valid, errors, json.
    """
    calls = calls.select("conv_id", F.col("position").cast("long").alias("position"), "call_id", "tool", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    results = results.select("conv_id", F.col("position").cast("long").alias("position"), "call_id", "content")
    ids = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("same"))
    held = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("position", "content")).alias("first"))
    known = calls.where("call_id is not null").select("conv_id", F.col("call_id").alias("need")).distinct()
    missing = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct().join(known, ["conv_id", "need"], "left_anti")
    missing = missing.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("need")).alias("missing"))
    level = levels(calls)
    key = ["conv_id", "call_id"]
    joined = calls.join(ids, key, "left").join(held, key, "left").join(missing, key, "left").join(level.withColumn("in_graph", F.lit(True)), key, "left").join(schemas, "tool", "left")
    errors = F.concat(
        argument_errors(F.col("arguments"), F.col("fields")),
        F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda n: F.concat(F.lit("needs unknown call "), n)),
        F.when(F.col("in_graph") & F.col("level").isNull(), F.array(F.lit("needs itself"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("same") > 1, F.array(F.lit("repeated call_id"))).otherwise(F.array().cast("array<string>")),
    )
    depth = F.when(F.col("in_graph"), F.col("level")).otherwise(F.lit(0))
    shown = joined.select(
        "conv_id", F.lit("call").alias("kind"), "call_id", "position", depth.alias("level"), "tool", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), errors.alias("errors"),
        "arguments", "needs", F.col("first")["content"].alias("content"),
    )
    place = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "position", "call_id", "tool", "arguments")
    ordered = shown.withColumn("ord", (F.row_number().over(place) - 1).cast("long"))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"needs":'), F.to_json(F.array_sort("needs")),
        F.lit(',"result":'), quoted(F.col("content")), F.lit(',"tool":'), quoted(F.col("tool")), F.lit("}"),
    )
    out = ordered.select("conv_id", "kind", "call_id", "position", "level", "ord", "tool", "n_results", (F.size("errors") == 0).alias("valid"), "errors", line.alias("json"))
    orphans = results.join(known.withColumnRenamed("need", "call_id"), key, "left_anti")
    none = lambda t: F.lit(None).cast(t)
    return out.unionByName(orphans.select(
        "conv_id", F.lit("orphan").alias("kind"), "call_id", "position", none("int").alias("level"), none("long").alias("ord"), none("string").alias("tool"), F.lit(1).cast("long").alias("n_results"),
        F.lit(False).alias("valid"), F.array(F.lit("result without a call")).alias("errors"), F.concat(F.lit('{"id":'), quoted(F.col("call_id")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}")).alias("json"),
    ))


def quoted(text: Column) -> Column:
    """A string as JSON, null as ``null``."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def calls_of_chats(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in the shape of the given chats, which hold none: every user turn asks for a tool and the turn after
    it answers. The tool, the arguments and their faults follow the text, so that they grow with the data.

    A call's id is its turn's number; it needs the call two turns before, and on every 11th length also the one two turns
    after, which is a cycle where that one is there. Arguments lack a field, have one of another type or one too many by
    the text's length. Turns without conv_id or turn are left out.
    """
    turns = chats.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    id_ = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    n, text, turn = F.col("n"), F.col("text"), F.col("turn")
    query = F.to_json(F.struct(F.col("text").alias("query"), n.alias("limit")))
    lookup = F.to_json(F.struct((n % 7 == 0).alias("exact"), F.when(n % 5 == 0, n.cast("string")).otherwise(text).alias("term")))
    count = F.to_json(F.struct(F.when(n % 3 == 0, n.cast("string")).alias("size"), F.when(n % 3 != 0, n).alias("length")))
    arguments = F.when(n % 13 == 0, text).when(n % 3 == 0, query).when(n % 3 == 1, lookup).otherwise(count)
    tool = F.when(n % 17 == 0, F.lit("unlisted")).when(n % 3 == 0, F.lit("search")).when(n % 3 == 1, F.lit("lookup")).otherwise(F.lit("count"))
    needs = F.filter(F.array(F.when(turn >= 2, id_(turn - 2)), F.when(n % 11 == 0, id_(turn + 2))), lambda x: x.isNotNull())
    asked = turns.where("role = 'user'").select("conv_id", turn.alias("position"), id_(turn).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), needs.alias("needs"))
    answers = turns.where("role = 'assistant'").select("conv_id", turn.alias("position"), id_(turn - 1).alias("call_id"), text.alias("content"))
    return asked, answers


#: The tools of ``calls_of_chats``.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "lookup": {"term": ("string", True), "exact": ("boolean", False)},
    "count": {"length": ("integer", True)},
}
