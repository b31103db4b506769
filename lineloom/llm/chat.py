"""Tool-call linking in DataFrame operations only: calls and results meet in a hash join on their identifier,
dependencies give a topological level, arguments are validated against schemas, and every call is written
as canonical JSON (keys sorted at every depth, no white space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.graph import small
from lineloom.session import materialize

#: JSON types and the variant types that satisfy them.
TYPES = {"integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "string": "STRING", "boolean": "BOOLEAN",
         "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): 0 for nodes without dependencies, else one more than the highest level among them; null on
    and behind cycles. ``edges`` are (id, dep); repeated ones count once, those to unknown nodes not at all.

    A node with one open dependency has level max(a, level(dep) + b). Such functions compose, so chains of any
    length are followed by doubling, in a number of joins that grows with the logarithm of their length; only
    nodes that wait for several open dependencies need another turn. No group is gathered anywhere.
    """
    ids = nodes.select("id").filter("id is not null").distinct()
    known_ids = ids.select(F.col("id").alias("dep"))
    open_ = materialize(edges.select("id", "dep").distinct().join(known_ids, "dep", "left_semi").join(ids, "id", "left_semi"))
    known = materialize(ids.join(open_.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(0).cast("long")))
    while open_.take(1):
        at = open_.join(known.withColumnsRenamed({"id": "dep"}), "dep", "left")
        state = materialize(at.groupBy("id").agg(
            F.sum(F.col("level").isNull().cast("int")).alias("waits"), F.coalesce(F.max(F.col("level") + 1), F.lit(0)).alias("a"),
            F.max(F.when(F.col("level").isNull(), F.col("dep"))).alias("to")))
        ready = state.filter("waits = 0").select("id", F.col("a").alias("level"))
        chain = materialize(state.filter("waits = 1").select("id", "to", "a", F.lit(1).cast("long").alias("b")))
        longest, reach = chain.count(), 1
        while reach <= longest:
            nxt = chain.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            if not chain.join(nxt, "to", "left_semi").take(1):
                break
            joined = chain.join(nxt, "to", "left")
            chain = materialize(joined.select("id", F.coalesce("to2", "to").alias("to"), F.greatest("a", F.col("a2") + F.col("b")).alias("a"), (F.col("b") + F.coalesce("b2", F.lit(0))).alias("b")))
            reach *= 2
        ends = ready.select(F.col("id").alias("to"), "level")
        solved = chain.join(ends, "to").select("id", F.greatest("a", F.col("level") + F.col("b")).alias("level"))
        new = materialize(ready.unionByName(solved))
        if not new.take(1):
            break
        known = materialize(known.unionByName(new))
        open_ = materialize(open_.join(known.select("id"), "id", "left_anti"))
    return ids.join(known, "id", "left")


def kind_of(value: Column) -> Column:
    """The JSON type of a variant; ``integer`` for whole numbers."""
    found = F.schema_of_variant(value)
    out = F.lit("null")
    for name in ("array", "object", "boolean", "string", "number", "integer"):
        out = F.when(found.rlike(f"^({TYPES[name]})$"), name).otherwise(out)
    return out


def problems(arguments: Column, schema: Column) -> Column:
    """What is wrong with the arguments (a map of variants), sorted: ``missing:p``, ``type:p``, ``unknown:p``.
    ``schema`` is map<parameter, struct<type, required>>, null for an unknown tool."""
    given, entries = arguments, F.map_entries(schema)
    kinds = F.transform_values(given, lambda _, v: kind_of(v))
    missing = F.transform(F.filter(entries, lambda e: e["value"]["required"] & ~F.map_contains_key(given, e["key"])), lambda e: F.concat(F.lit("missing:"), e["key"]))
    fits = lambda want, have: (want == have) | ((want == "number") & (have == "integer"))
    wrong = F.transform(F.filter(entries, lambda e: F.map_contains_key(given, e["key"]) & ~fits(e["value"]["type"], F.element_at(kinds, e["key"]))), lambda e: F.concat(F.lit("type:"), e["key"]))
    unknown = F.transform(F.filter(F.map_keys(given), lambda k: ~F.map_contains_key(schema, k)), lambda k: F.concat(F.lit("unknown:"), k))
    return F.array_sort(F.concat(missing, wrong, unknown))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, depends: DataFrame) -> DataFrame:
    """(id, name, level, linked, valid, problems, message): one row per call identifier.

    calls (id, name, arguments JSON), results (id, content), schemas (name, parameter, type, required), depends
    (id, dep). A call or result given again counts once: the least name and arguments, the least content. Null
    identifiers link with nothing and are left out. Missing or malformed arguments are ``malformed``, a tool
    without schema is ``unknown tool``; such calls keep their row. A call without result has no result key in
    its message; a result without call is left out. A cyclic dependency gives a null level. Other columns are
    ignored, empty tables give no rows.
    """
    one = calls.filter("id is not null").groupBy("id").agg(F.min(F.struct("name", "arguments")).alias("c")).select("id", "c.name", "c.arguments")
    content = results.filter("id is not null").groupBy("id").agg(F.min("content").alias("content"), F.lit(True).alias("_met"))
    tools = materialize(schemas.filter("name is not null and parameter is not null").groupBy("name", "parameter").agg(F.min("type").alias("type"), F.max("required").alias("required")))
    tools = tools.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("parameter", F.struct("type", "required")))).alias("_schema"))
    met = one.join(content.hint("shuffle_hash"), "id", "left").join(small(materialize(tools)), "name", "left")
    parsed = met.withColumn("_arguments", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("_map", F.when(F.schema_of_variant("_arguments").startswith("OBJECT"), F.col("_arguments")).cast("map<string, variant>"))
    wrong = (F.when(F.col("_arguments").isNull(), F.array(F.lit("malformed"))).when(F.col("_map").isNull(), F.array(F.lit("not an object")))
             .when(F.col("_schema").isNull(), F.array(F.lit("unknown tool"))).otherwise(problems(F.col("_map"), F.col("_schema"))))
    message = F.to_json(F.struct(F.col("_arguments").alias("arguments"), "id", "name", F.col("content").alias("result")))
    order = levels(one, depends)
    return parsed.withColumn("problems", wrong).withColumn("message", message).join(order, "id", "left").select(
        "id", "name", "level", F.coalesce("_met", F.lit(False)).alias("linked"), (F.size("problems") == 0).alias("valid"), "problems", "message")


SAY = "respond"


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, results, schemas and dependencies of plain conversations (conv_id, turn, role, text).

    A user's turn calls the tool ``respond`` with the turn and its text; the assistant's next turn is the result;
    a call depends on the call two turns before. Rows with a null conversation or turn give null identifiers."""
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    asked, told = turns.filter("role = 'user'"), turns.filter("role = 'assistant'")
    arguments = F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("prompt")))
    calls = asked.select(name(turn).alias("id"), F.lit(SAY).alias("name"), arguments.alias("arguments"))
    results = told.select(name(turn - 1).alias("id"), F.col("text").alias("content"))
    depends = asked.select(name(turn).alias("id"), name(turn - 2).alias("dep"))
    schemas = turns.sparkSession.createDataFrame([(SAY, "prompt", "string", True), (SAY, "turn", "integer", True)], "name string, parameter string, type string, required boolean")
    return calls, results, schemas, depends
