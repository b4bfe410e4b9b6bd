"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Calls and results meet by a hash join on (conversation, call id). Inside a message, calls are put
in topological order of what they wait for, in one pass over the message's waits. Arguments are checked against the tool's schema and
written as canonical JSON (keys sorted, no blanks). One row per message comes out: a conversation,
however long, is never gathered in one place, and messages order it by their turns.

Statuses: ``ok``, ``no_result``, ``unknown_tool``, ``invalid`` (arguments are no JSON object, hold NaN or
infinity, are nested deeper than the JSON reader goes, or break the schema; no arguments fit a schema
that is no JSON object or breaks its own rules), ``missing`` (waits for a call that isn't in the conversation or comes in a later turn) and
``cycle`` (waits, directly or not, for itself in one message); the first that applies from the right.
Of repeated calls with one id, the one of the earliest turn counts, then the least name and
arguments; of repeated results, the earliest, then the least. Results without a call are listed as
orphans of their own turn. Rows with a null conversation, call id or turn are left out of linking and
not returned: they can't be told apart. Empty tables give an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lectern.llm.common import stored

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: object) -> str:
    """Halves of surrogate pairs, which no encoding takes, stay escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _same(a: object, b: object) -> bool:
    """Equal JSON values; truth is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def fits(value: object, schema: dict) -> bool:
    """JSON Schema's type, enum, minimum, maximum, minLength, maxLength, required, properties,
    additionalProperties (true or false) and items."""
    kinds = schema.get("type")
    for kind in [kinds] if isinstance(kinds, str) else kinds or []:
        if kind in ("integer", "number"):
            good = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
        else:
            good = isinstance(value, _TYPES.get(kind, object))
        if good:
            break
    else:
        if kinds:
            return False
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]):
        return False
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return False
    if isinstance(value, list) and "items" in schema:
        return all(fits(v, schema["items"]) for v in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if not set(schema.get("required", ())) <= set(value) or (schema.get("additionalProperties") is False and not set(value) <= set(known)):
            return False
        return all(fits(value[k], s) for k, s in known.items() if k in value)
    return True


@F.pandas_udf(Ty.StructType([Ty.StructField("valid", Ty.BooleanType()), Ty.StructField("text", Ty.StringType())]))
def _checked(arguments: pd.Series, schema: pd.Series) -> pd.DataFrame:
    read: dict[str, object] = {}
    out = []
    for body, rule in zip(arguments, schema, strict=True):
        if rule is not None and rule not in read:
            read[rule] = _json(rule)
        value = _json(body)
        out.append((isinstance(value, dict) and (rule is None or _meets(value, read[rule])), _written(value)))
    return pd.DataFrame(out, columns=["valid", "text"])


_NONE = object()


def _json(text: str | None) -> object:
    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse)
    except (TypeError, ValueError, RecursionError):
        return _NONE


def _meets(value: object, schema: object) -> bool:
    try:
        return isinstance(schema, dict) and _written(value) is not None and fits(value, schema)
    except (TypeError, ValueError, AttributeError, RecursionError):
        return False


def _written(value: object) -> str | None:
    try:
        return None if value is _NONE else canonical(value)
    except (ValueError, RecursionError):
        return None


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def depths(waits: list[dict]) -> dict[str, int | None]:
    """``waits`` (call_id, other) of one message: the longest chain below each call that waits; None on
    or behind a cycle. Calls that wait for none are at 0 and not listed."""
    others: dict[str, set] = {}
    for w in waits:
        others.setdefault(w["call_id"], set()).add(w["other"])
    behind: dict[str, list] = {}
    for call, of in others.items():
        for other in of:
            behind.setdefault(other, []).append(call)
    left = {call: sum(o in others for o in of) for call, of in others.items()}
    level, ready = {}, [call for call, n in left.items() if n == 0]
    for call in ready:
        level[call] = 1 + max(level.get(o, 0) for o in others[call])
        for later in behind.get(call, ()):
            left[later] -= 1
            if left[later] == 0:
                ready.append(later)
    return {call: level.get(call) for call in others}


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, missing): the longest chain of calls of the same message below each;
    level is null for calls on or behind a cycle. A message's waits are gathered once, as its calls
    are when it is written."""
    keys = ["conv_id", "call_id"]
    waits = calls.select(*keys, "turn", F.explode("waits_for").alias("other")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("other"), F.col("turn").alias("other_turn"))
    met = stored(waits.join(known, ["conv_id", "other"], "left"))
    lost = met.filter(F.col("other_turn").isNull() | (F.col("other_turn") > F.col("turn"))).select(*keys).distinct().withColumn("missing", F.lit(True))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, levels = [], [], []
            for k, waiting in enumerate(batch.column(1).to_pylist()):
                for call, level in depths(waiting).items():
                    at.append(k)
                    ids.append(call)
                    levels.append(level)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.string()), pa.array(levels, pa.int32())], names=["conv_id", "call_id", "depth"])

    inside = met.filter("other_turn = turn").groupBy("conv_id", "turn").agg(F.collect_list(F.struct("call_id", "other")).alias("waits"))
    kind = calls.schema["conv_id"].dataType.simpleString()
    deep = inside.select("conv_id", "waits").mapInArrow(order, f"conv_id {kind}, call_id string, depth int").withColumn("waits", F.lit(True))
    placed = calls.select(*keys).join(deep, keys, "left").select(*keys, F.when(F.col("waits"), F.col("depth")).otherwise(F.lit(0)).alias("level"))
    return placed.join(lost, keys, "left")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` (conv_id, turn, call_id, name, arguments, waits_for array), ``results`` (conv_id, turn,
    call_id, content), ``schemas`` (name, schema) into one row per call or orphan: conv_id, turn,
    call_id, level, status, line (canonical JSON)."""
    keys = ["conv_id", "call_id"]
    present = "conv_id IS NOT NULL AND call_id IS NOT NULL AND turn IS NOT NULL"
    cols = ["conv_id", "turn", "call_id", "name", "arguments", F.coalesce("waits_for", F.array().cast("array<string>")).alias("waits_for")]
    own = stored(_first(calls.filter(present).select(*cols), keys, ["turn", "name", "arguments"]))
    got = _first(results.filter(present).select("conv_id", "turn", "call_id", "content"), keys, ["turn", "content"])
    got = got.select(*keys, F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"))
    rules = _first(schemas.filter("name IS NOT NULL").select("name", "schema"), ["name"], ["schema"]).withColumn("known", F.lit(True))

    both = own.join(got, keys, "full_outer").join(rules, "name", "left").join(_levels(own), keys, "left")
    both = both.withColumn("checked", _checked("arguments", "schema"))
    is_call = F.col("turn").isNotNull()
    status = (
        F.when(~is_call, "orphan").when(F.col("level").isNull(), "cycle").when(F.col("missing"), "missing").when(~F.col("checked.valid"), "invalid")
        .when(F.col("known").isNull(), "unknown_tool").when(F.col("answered").isNull(), "no_result").otherwise("ok")
    )
    return both.select(
        "conv_id", F.coalesce("turn", "result_turn").alias("turn"), "call_id", "level", status.alias("status"),
        _line(F.col("call_id"), F.col("name"), F.col("checked.text"), F.col("content")).alias("line"))


def _line(call_id: Column, name: Column, arguments: Column, content: Column) -> Column:
    """Canonical JSON of one call; arguments are canonical already."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    part = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))
    parts = [part("arguments", arguments), part("id", quoted(call_id)), part("name", F.when(name.isNotNull(), quoted(name))), part("result", F.when(content.isNotNull(), quoted(content)))]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def format_messages(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message that holds a call or an orphan: conv_id, turn, counts, and ``messages``, the
    JSON list of its calls by level and id (calls without a level, then orphans, last)."""
    lines = link(calls, results, schemas)
    rank = F.struct(F.when(F.col("status") == "orphan", 2).when(F.col("level").isNull(), 1).otherwise(0).alias("kind"), F.coalesce("level", F.lit(0)).alias("level"), "call_id", "line")
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "no_result", "unknown_tool", "invalid", "missing", "cycle", "orphan")]
    grouped = lines.groupBy("conv_id", "turn").agg(*counts, F.array_sort(F.collect_list(rank)).alias("rows"))  # one message's calls
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["line"]), ","), F.lit("]"))
    return grouped.select("conv_id", "turn", *[f"n_{s}" for s in ("ok", "no_result", "unknown_tool", "invalid", "missing", "cycle", "orphan")], text.alias("messages"))


# Tools that the lines of user turns are read as; fixed values.
TOOLS = {
    "search": {"type": "object", "required": ["query", "size"], "properties": {"query": {"type": "string", "minLength": 12}, "size": {"type": "integer", "minimum": 1}}},
    "translate": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "maxLength": 150}, "size": {"type": "integer"}}},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas from plain conversations, which hold no tool calls: each line of a user
    turn calls a tool (search, translate, or an unknown one), each line of the next turn, if it's the
    assistant's, answers the call of its place. Line i waits for line i // 2 (from 1)."""
    spark = conversations.sparkSession
    lines = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).withColumn("at", F.col("at") + 1)
    named = lambda turn, at: F.concat(F.lit("t"), turn.cast("string"), F.lit("c"), at.cast("string"))
    size = F.length("line")
    tool = F.when(size % 7 == 0, "browse").when(size % 2 == 0, "search").otherwise("translate")
    waits = F.when(F.col("at") > 1, F.array(named(F.col("turn"), F.floor(F.col("at") / 2).cast("int")))).otherwise(F.array().cast("array<string>"))
    calls = lines.filter("role = 'user'").select(
        "conv_id", "turn", named(F.col("turn"), F.col("at")).alias("call_id"), tool.alias("name"),
        F.to_json(F.struct(size.alias("size"), F.col("line").alias("query"))).alias("arguments"), waits.alias("waits_for"))
    results = lines.filter("role = 'assistant'").select("conv_id", "turn", named(F.col("turn") - 1, F.col("at")).alias("call_id"), F.col("line").alias("content"))
    schemas = spark.createDataFrame([(k, canonical(v)) for k, v in TOOLS.items()], "name string, schema string")
    return calls, results, schemas
