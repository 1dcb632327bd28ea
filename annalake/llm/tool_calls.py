"""Chat formatting: tool calls linked with their results, ordered and serialised.

Calls and results meet in a hash join on their identifier. A call may follow
another one; its level is the number of calls before it on that path, found by
pointer doubling, so a path of n calls takes log n rounds and no conversation
is gathered anywhere. (level, call_id) is a topological order within a
conversation. Arguments are parsed as variants, checked against the tool's
fields and written as canonical JSON: no white space, keys in order.

DataFrame functions only. Defined results: calls and results that repeat an
identifier are one row with their numbers, and the smallest content is shown;
rows without an identifier stay as they are, state ``unnamed``. A result without
a call has state ``orphan``, a call without a result ``pending``, one that
follows itself in the end ``cyclic`` and no level. A call that follows one that
isn't there begins a path. A conversation id may be NULL. NULL arguments, other
text than JSON and repeated keys are errors; tools without fields are unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalake.llm.common import scratch, stored

_KEY = ("conv_id", "call_id")


def _same(left: DataFrame, right: DataFrame, conv: str = "conv_id", call: str = "call_id") -> Column:
    return left[conv].eqNullSafe(right["_conv"]) & (left[call] == right["_call"])


def _levels(calls: DataFrame, folder: str) -> DataFrame:
    """_conv, _call, level of every call; NULL where its path has no start."""
    known = calls.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
    first = calls.select("conv_id", "call_id", "follows").join(known, _same(calls, known, call="follows"), "left")
    paths = stored(first.select("conv_id", "call_id", F.col("_call").alias("ahead"), F.col("_call").isNotNull().cast("long").alias("level")), f"{folder}/0")
    turn, open_paths = 0, paths.where("ahead IS NOT NULL").count()
    while open_paths:
        turn += 1
        step = paths.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("ahead").alias("_ahead"), F.col("level").alias("_level"))
        joined = paths.join(step, _same(paths, step, call="ahead"), "left")
        paths = stored(joined.select("conv_id", "call_id", F.col("_ahead").alias("ahead"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")), f"{folder}/{turn}")
        still = paths.where("ahead IS NOT NULL").count()
        if still == open_paths:  # every round ends the shortest of the paths that have a start
            break
        open_paths = still
    return paths.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.when(F.col("ahead").isNull(), F.col("level")).alias("level"))


def _errors(arguments: Column, fields: Column) -> Column:
    """What is wrong with a call, in a fixed order. arguments: variant, fields: of the tool."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    own = F.when(is_object, arguments.cast("map<string,variant>"))
    has = lambda f: F.map_contains_key(own, f["field"])
    kind = lambda f: F.regexp_extract(F.schema_of_variant(own[f["field"]]), "^[A-Z]+", 0)
    missing = F.transform(F.filter(fields, lambda f: f["required"] & ~has(f)), lambda f: F.concat(F.lit("missing "), f["field"]))
    wrong = F.transform(F.filter(fields, lambda f: F.when(has(f), kind(f) != f["type"]).otherwise(F.lit(False))), lambda f: F.concat(F.lit("not "), F.lower(f["type"]), F.lit(": "), f["field"]))
    named = F.transform(fields, lambda f: f["field"])
    strange = F.transform(F.array_sort(F.array_except(F.map_keys(own), named)), lambda k: F.concat(F.lit("unknown "), k))
    return (
        F.when(fields.isNull(), F.array(F.lit("unknown tool")))
        .when(arguments.isNull(), F.array(F.lit("arguments are not JSON")))
        .when(~is_object, F.array(F.lit("arguments are not an object")))
        .otherwise(F.concat(missing, wrong, strange))
    )


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """calls: conv_id, call_id, follows, tool, arguments (JSON text). results:
    conv_id, call_id, content. tools: tool, field, type (name of a variant's
    type), required. Returns conv_id, call_id, level, state, n_calls, n_results,
    valid, errors (joined by ``; ``) and record (canonical JSON)."""
    folder = scratch(calls.sparkSession)
    calls = calls.select("conv_id", "call_id", "follows", "tool", "arguments")
    results = results.select("conv_id", "call_id", "content")
    one = F.min(F.struct("tool", "arguments", "follows")).alias("call")
    asked = calls.where("call_id IS NOT NULL").groupBy(*_KEY).agg(one, F.count(F.lit(1)).alias("n_calls"))
    asked = stored(asked.select(*_KEY, "call.tool", "call.arguments", "call.follows", "n_calls"), f"{folder}/asked")
    levels = _levels(asked, f"{folder}/levels")
    asked = asked.join(levels, _same(asked, levels)).select(*_KEY, "tool", "arguments", "n_calls", "level")

    given = results.where("call_id IS NOT NULL").groupBy(*_KEY).agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results"))
    given = given.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "content", "n_results")
    linked = asked.join(given.hint("shuffle_hash"), _same(asked, given), "full_outer")
    state = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("level").isNull(), "cyclic").when(F.col("n_results").isNull(), "pending").otherwise("answered")
    linked = linked.withColumn("state", state).select(F.coalesce("conv_id", "_conv").alias("conv_id"), F.coalesce("call_id", "_call").alias("call_id"), "level", "state", "n_calls", "n_results", "tool", "arguments", "content")

    no_level, no_text = F.lit(None).cast("long").alias("level"), F.lit(None).cast("string")
    unnamed_calls = calls.where("call_id IS NULL").select(*_KEY, no_level, F.lit("unnamed").alias("state"), F.lit(1).alias("n_calls"), F.lit(0).alias("n_results"), "tool", "arguments", no_text.alias("content"))
    unnamed_results = results.where("call_id IS NULL").select(*_KEY, no_level, F.lit("unnamed").alias("state"), F.lit(0).alias("n_calls"), F.lit(1).alias("n_results"), no_text.alias("tool"), no_text.alias("arguments"), "content")
    rows = linked.unionByName(unnamed_calls).unionByName(unnamed_results)

    fields = tools.groupBy(F.col("tool").alias("_tool")).agg(F.array_sort(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))  # as small as a schema
    rows = rows.join(fields, F.col("tool") == F.col("_tool"), "left").withColumn("parsed", F.try_parse_json("arguments"))
    is_call = F.coalesce("n_calls", F.lit(0)) > 0
    errors = F.when(is_call, _errors(F.col("parsed"), F.col("fields"))).otherwise(F.array().cast("array<string>"))
    record = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("content").alias("result"), "tool"), {"ignoreNullFields": "false"})
    rows = rows.withColumn("wrong", errors)
    return rows.select(
        *_KEY,
        "level",
        "state",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(is_call, F.size("wrong") == 0).alias("valid"),
        F.array_join("wrong", "; ").alias("errors"),
        record.alias("record"),
    )


#: Fields of the tools that the query's calls are made for.
TOOLS = (
    ("search", "query", "STRING", True),
    ("search", "words", "BIGINT", True),
    ("search", "turn", "BIGINT", False),
    ("summarise", "text", "STRING", True),
    ("summarise", "limit", "BIGINT", True),
    ("summarise", "language", "STRING", True),
)
#: Words from which a user's turn asks for a summary.
LONG_TURN = 30


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and tools that the turns of conversations stand for: each
    user's turn calls a tool and follows the user's turn before, the next turn of
    the assistant is its result. Short turns search; long ones ask for a summary,
    in every third turn without saying the language."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    words = F.size(F.split("text", " ")).cast("long")
    turn = F.col("turn")
    search = F.to_json(F.struct(words.alias("words"), F.col("text").alias("query"), "turn"))
    summary = F.to_json(F.struct("text", F.when(turn % 3 != 0, F.lit("und")).alias("language"), F.length("text").cast("long").alias("limit")))
    is_long = words >= LONG_TURN
    calls = rows.where("role = 'user'").select(
        "conv_id",
        name(turn).alias("call_id"),
        F.when(turn >= 2, name(turn - 2)).alias("follows"),
        F.when(is_long, "summarise").otherwise("search").alias("tool"),
        F.when(is_long, summary).otherwise(search).alias("arguments"),
    )
    results = rows.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    tools = conversations.sparkSession.createDataFrame(list(TOOLS), "tool string, field string, type string, required boolean")
    return calls, results, tools


def oracle() -> str:
    """The same with a recursive query for the levels."""
    return f"""
    WITH RECURSIVE rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, len(string_split(coalesce(text, ''), ' ')) AS words FROM conversations),
    calls AS (
      SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, turn - 2 AS follows, count(*) AS n_calls,
        min(CASE WHEN words >= {LONG_TURN} THEN 'summarise' ELSE 'search' END) AS tool,
        min(CASE WHEN words >= {LONG_TURN} AND turn % 3 = 0 THEN to_json({{'limit': length(text), 'text': text}})
          WHEN words >= {LONG_TURN} THEN to_json({{'language': 'und', 'limit': length(text), 'text': text}})
          ELSE to_json({{'query': text, 'turn': turn, 'words': words}}) END::VARCHAR) AS arguments,
        min(CASE WHEN words >= {LONG_TURN} AND turn % 3 = 0 THEN 'missing language' ELSE '' END) AS errors
      FROM rows WHERE role = 'user' GROUP BY conv_id, turn),
    results AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results FROM rows WHERE role = 'assistant' GROUP BY conv_id, turn),
    levels(conv_id, turn, level) AS (
      SELECT conv_id, turn, 0 FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.follows)
      UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.follows = l.turn)
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, l.level::BIGINT AS level,
      CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'pending' ELSE 'answered' END AS state,
      coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results,
      CASE WHEN c.call_id IS NOT NULL THEN c.errors = '' END AS valid, coalesce(c.errors, '') AS errors,
      '{{"arguments":' || coalesce(c.arguments, 'null') || ',"id":' || to_json(coalesce(c.call_id, r.call_id))::VARCHAR || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null')
        || ',"tool":' || coalesce(to_json(c.tool)::VARCHAR, 'null') || '}}' AS record
    FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
    LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn"""
