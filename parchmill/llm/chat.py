"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on (conversation, identifier). A call may name the call it comes after; levels
of that order come from pointer doubling, a logarithmic number of joins on unique keys, so neither a long chain nor
a hot conversation is gathered in one task. Arguments are checked against a JSON schema for each tool, and every call
becomes one canonical JSON line: sorted keys, no blanks, no escapes but the necessary ones.

Defined results: a call without a result is "unanswered", a result without a call is "orphan" (it gives a record of
its own), a call whose chain never ends is "cyclic" and has no level; of repeated calls or results of one identifier
the first by turn, then by content, counts; a predecessor that does not exist is ignored; null identifiers never link
and give no rows; null or unreadable arguments and unknown tools are invalid, and unreadable arguments stay as text. Unreadable is what is not
JSON (NaN and infinite numbers too), what names a key twice, and what is nested deeper than Python's parser follows; a
lone surrogate is written as an escape.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.session import read_table, settled

KEY = ["conv_id", "call_id"]
JSON_TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}
#: The tools of the query below and what their arguments must look like.
SCHEMAS = {
    "reply": {"type": "object", "required": ["role", "text", "turn"], "additionalProperties": False, "properties": {"role": {"type": "string", "enum": ["user"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "instruct": {"type": "object", "required": ["role", "text", "turn"], "additionalProperties": False, "properties": {"role": {"type": "string", "enum": ["system"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}},
}


def fits(value, schema: dict) -> bool:
    """A value against the common part of JSON Schema: type, enum, properties, required, additionalProperties, items, and limits."""
    kinds = schema.get("type")
    if kinds is not None:
        allowed = [kinds] if isinstance(kinds, str) else kinds
        if not any(isinstance(value, JSON_TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in allowed):
            return False
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(fits(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list):
        return "items" not in schema or all(fits(v, schema["items"]) for v in value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, int | float) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    return True


SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def read_arguments(text: str | None, schema: dict | None) -> tuple[object, bool]:
    """The value and whether it fits; unreadable text as it is."""
    try:
        value = json.loads(text, object_pairs_hook=_once) if text is not None else None
        canonical(value)  # what can be read must be writable
        return value, text is not None and schema is not None and fits(value, schema)
    except (ValueError, RecursionError):
        return text, False


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: how many calls come before each along its chain; null on a cycle. Each round doubles the
    stretch of chain that a row has seen, so the rounds end when all have seen a start or the doubled stretch passes
    the number of calls."""
    own = calls.select(*KEY, "after")
    known = own.select("conv_id", F.col("call_id").alias("after"))
    state = settled(own.join(known.withColumn("_is", F.lit(True)), ["conv_id", "after"], "left").select(*KEY, F.when(F.col("_is"), F.col("after")).alias("up")).withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "levels")
    limit, stretch = state.count(), 1
    while stretch <= limit and not state.where("up is not null").isEmpty():
        ahead = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        state = settled(state.join(ahead, ["conv_id", "up"], "left").select(*KEY, F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        stretch *= 2
    return state.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_tools(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, level, status, valid, record. calls: conv_id, call_id, turn, after, name, arguments (JSON text);
    results: conv_id, call_id, turn, content."""
    first = lambda df, *cols: settled(df.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min(F.struct("turn", *cols)).alias("x")).select(*KEY, "x.*"), "first")
    asked, answered = first(calls, "name", "arguments", "after"), first(results, "content")
    ranked = levels(asked)
    joined = asked.withColumn("_call", F.lit(True)).join(ranked, KEY).join(answered.select(*KEY, "content", F.lit(True).alias("_result")), KEY, "full")
    rows = joined.select(*KEY, "level", F.expr("case when _call is null then 'orphan' when level is null then 'cyclic' when _result is null then 'unanswered' else 'linked' end").alias("status"), "name", "arguments", "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                valid, records = [], []
                for call, level, status, name, arguments, content in zip(*(b.column(n).to_pylist() for n in ("call_id", "level", "status", "name", "arguments", "content")), strict=True):
                    parsed, good = read_arguments(arguments, None if status == "orphan" else schemas.get(name))
                    valid.append(good)
                    records.append(canonical({"arguments": parsed, "call_id": call, "level": level, "name": name, "result": content, "status": status, "valid": good}))
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("call_id"), b.column("level"), b.column("status"), pa.array(valid, pa.bool_()), pa.array(records, pa.string())], names=["conv_id", "call_id", "level", "status", "valid", "record"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(write, f"conv_id {kind['conv_id']}, call_id {kind['call_id']}, level long, status string, valid boolean, record string")


def turns_as_tools(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation as calls and results: what a user or system says is a call, after the one two turns before; what the
    assistant says answers the turn before it."""
    ident = lambda back: F.concat("conv_id", F.lit(":"), F.col("turn") - back)
    calls = turns.where("role <> 'assistant'").select(
        "conv_id", ident(0).alias("call_id"), "turn", ident(2).alias("after"), F.when(F.col("role") == "system", "instruct").otherwise("reply").alias("name"), F.to_json(F.struct("role", "text", "turn")).alias("arguments")
    )
    results = turns.where("role = 'assistant'").select("conv_id", ident(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_tools(read_table(spark, sf_dir, "conversations"))
    return link_tools(calls, results, SCHEMAS)


OP4_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, conv_id || ':' || turn AS call_id, turn, role, text, CASE WHEN role = 'system' THEN 'instruct' ELSE 'reply' END AS name FROM conversations WHERE role <> 'assistant'),
a AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
      UNION ALL SELECT c.conv_id, c.turn, r.level + 1 FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn + 2),
j AS (SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.turn, role, text, name, content, c.conv_id IS NOT NULL AS is_call, a.conv_id IS NOT NULL AS is_result
      FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.call_id = a.call_id),
s AS (SELECT j.*, r.level, CASE WHEN NOT is_call THEN 'orphan' WHEN NOT is_result THEN 'unanswered' ELSE 'linked' END AS status,
        coalesce(is_call AND length(text) >= 1 AND ((role = 'user' AND j.turn >= 0) OR (role = 'system' AND j.turn = 0)), false) AS valid FROM j LEFT JOIN r ON j.conv_id = r.conv_id AND j.turn = r.turn)
SELECT conv_id, call_id, CAST(level AS BIGINT) AS level, status, valid,
  CAST(json_object('arguments', CASE WHEN is_call THEN json_object('role', role, 'text', text, 'turn', turn) END, 'call_id', call_id, 'level', level, 'name', name, 'result', content, 'status', status, 'valid', valid) AS VARCHAR) AS record
FROM s
"""
