"""Tool calls and their results in chats: linked, ordered, validated and serialised.

Calls and results are hash-joined by the call's identifier. Calls are ordered topologically: those without dependencies have level 0, others one
more than the highest of theirs. What hangs together through dependencies is found by contraction; each such group is ordered in one task if
its links are few, and groups of more than MOST_LINKS links are ordered together by rounds of joins, one a level. What is on or behind a
cycle has no level. Arguments are validated against the tool's schema, and each call is serialised with its result as canonical JSON: sorted
keys, no white space, one row a call.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.components import components
from tidegauge.llm.shared import new_path, written

#: Largest group of dependent calls that one task orders by itself, in links.
MOST_LINKS = 100_000
#: JSON text may name lone surrogates, which UTF-8 can't hold: they stay escaped.
SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    """Canonical JSON: keys sorted by code point, no white space, whole floats as integers, lone surrogates escaped."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return _encodable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _encodable(text: str) -> str:
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, float):
            return math.isfinite(value) and (kind == "number" or value.is_integer())
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, ()))  # a type that isn't known is met by nothing


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What in value breaks the schema: type, enum, bounds, lengths, pattern, required, properties, additionalProperties, items."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the values allowed")
    if _is(value, "number"):
        out += [f"{at}: {what} than {schema[key]}" for key, what, bad in (("minimum", "less", lambda b: value < b), ("maximum", "more", lambda b: value > b)) if key in schema and bad(schema[key])]
    if isinstance(value, (str, list)):
        unit = "Length" if isinstance(value, str) else "Items"
        if len(value) < schema.get(f"min{unit}", 0) or len(value) > schema.get(f"max{unit}", math.inf):
            out.append(f"{at}: wrong number of {'characters' if unit == 'Length' else 'items'}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: does not match the pattern")
    if isinstance(value, list) and "items" in schema:
        out += [e for i, x in enumerate(value) for e in errors(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                out += errors(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    return out


def ordered(links: pd.DataFrame) -> pd.DataFrame:
    """(call_id, level) of the calls in some links (call_id, on); null on or behind a cycle."""
    waits: dict[str, int] = {}
    after: dict[str, list[str]] = {}
    for call, on in zip(links["call_id"], links["on"], strict=True):
        waits[call] = waits.get(call, 0) + 1
        waits.setdefault(on, 0)
        after.setdefault(on, []).append(call)
    level = {x: 0 for x, n in waits.items() if not n}
    work = list(level)
    for x in work:
        for call in after.get(x, ()):
            level[call] = max(level.get(call, 0), level[x] + 1)
            waits[call] -= 1
            if not waits[call]:
                work.append(call)
    done = set(work)
    found = pd.DataFrame({"call_id": list(waits)}, dtype=object)
    found["level"] = pd.array([level[x] if x in done else None for x in waits], dtype="Int32")
    return found


def _by_rounds(links: DataFrame) -> DataFrame:
    """The same for groups of any size, one round of joins a level."""
    nodes = links.select("call_id").unionByName(links.select(F.col("on").alias("call_id"))).distinct()
    done = nodes.join(links.select("call_id").distinct(), "call_id", "left_anti").withColumn("level", F.lit(0))
    every = new_path(links.sparkSession, "levels")  # a folder a level, so that the plan doesn't grow with the levels
    level = 0
    while True:
        done.write.parquet(f"{every}/{level}")
        now = links.sparkSession.read.schema("call_id string, level int").parquet(f"{every}/{level}")
        if links.isEmpty() or now.isEmpty():
            break
        level += 1
        left = written(links.join(now.select(F.col("call_id").alias("on")), "on", "left_anti"), "links")
        done = links.select("call_id").distinct().join(left.select("call_id").distinct(), "call_id", "left_anti").withColumn("level", F.lit(level))
        links = left
    placed = links.sparkSession.read.schema("call_id string, level int").parquet(*[f"{every}/{i}" for i in range(level + 1)])
    return placed.unionByName(links.select("call_id").distinct().withColumn("level", F.lit(None).cast("int")))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, depends_on), null for those on or behind a cycle. Dependencies on calls that aren't there don't count."""
    ids = calls.select("call_id")
    links = calls.select("call_id", F.explode("depends_on").alias("on")).distinct()
    links = written(links.join(ids.select(F.col("call_id").alias("on")), "on"), "links")
    loops = links.filter("call_id = on").select("call_id", F.lit(None).cast("int").alias("level"))
    groups = links.join(components(links, "call_id", "on").withColumnRenamed("node", "call_id"), "call_id")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    groups = written(groups.join(sizes, "root"), "groups")
    few, many = groups.filter(F.col("n") <= MOST_LINKS), groups.filter(F.col("n") > MOST_LINKS)
    found = few.select("root", "call_id", "on").groupBy("root").applyInPandas(lambda own: ordered(own), "call_id string, level int")
    if not many.isEmpty():
        found = found.unionByName(_by_rounds(many.select("call_id", "on")))
    known = found.unionByName(loops).groupBy("call_id").agg(F.max("level").alias("level"), F.max(F.col("level").isNull()).alias("none"))
    placed = ids.join(known, "call_id", "left")
    return placed.select("call_id", F.when(F.coalesce("none", F.lit(False)), None).otherwise(F.coalesce("level", F.lit(0))).alias("level"))


def checked(arguments: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """The value of JSON text, and what is wrong with it; a text that isn't JSON, is nested too deeply, or has numbers that aren't finite has no value.

    A schema that itself is wrong where it applies (a pattern that isn't one, a bound that is no number) is an error of the call, which keeps its value.
    """
    try:
        value = json.loads(arguments)
        canonical(value)  # raises for NaN and infinities
    except RecursionError:
        return None, ["$: nested too deeply"]
    except (TypeError, ValueError):
        return None, ["$: not JSON"]
    if schema is None:
        return value, ["$: no schema for this tool"]
    try:
        return value, errors(value, schema)
    except RecursionError:
        return None, ["$: nested too deeply"]
    except (re.error, AttributeError, KeyError, OverflowError, TypeError, ValueError) as e:
        return value, [f"$: the tool's schema is wrong ({type(e).__name__}: {e})"]


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conversation, turn, call_id, name, level, status, copies, n_results, valid, errors and message for every call, and for every result without one.

    calls: conversation, turn, call_id, name, arguments (JSON text), depends_on (array of call ids). results: turn, call_id, content. Calls that
    share an id are one, the first by turn and content, and ``copies`` says how many there are; of several results of a call the first by turn
    and content is in the message, and ``n_results`` counts them. status: linked, unanswered, orphan (a result without a call), cycle (an answered
    or unanswered call without a place in the order), or unidentified (a call or result with a null id, each a row of its own). Null or broken
    arguments, nesting too deep for Python and numbers of more than 4300 digits are invalid and serialised as null; tools without a schema
    are invalid, a schema that is wrong itself makes the calls that it is applied to invalid, and a type that isn't one of JSON Schema's is met by nothing. Lone surrogates stay escaped. Long texts are
    serialised whole. Further columns are not read; empty tables give empty results.
    """
    body = [c for c in ("conversation", "turn", "name", "arguments", "depends_on")]
    first = calls.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", *[c for c in body if c != "turn"])).alias("c"), F.count(F.lit(1)).alias("copies"))
    first = written(first.select("call_id", "copies", *[F.col(f"c.{c}").alias(c) for c in body]), "calls")
    answers = results.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    answers = answers.select("call_id", "n_results", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    placed = first.join(levels(first.select("call_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))), "call_id", "left")
    joined = placed.join(answers.hint("shuffle_hash"), "call_id", "full")
    status = F.when(F.col("copies").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    zero = F.lit(0).cast("long")
    rows = joined.select("conversation", F.coalesce("turn", "result_turn").alias("turn"), "call_id", "name", "level", status.alias("status"), F.coalesce("copies", zero).alias("copies"), F.coalesce("n_results", zero).alias("n_results"), "arguments", "depends_on", "content")
    alone = {"status": F.lit("unidentified"), "copies": F.lit(1).cast("long"), "n_results": zero}
    rows = rows.unionByName(calls.filter("call_id is null").select("call_id", *body).withColumns(alone), allowMissingColumns=True)
    alone = {"status": F.lit("unidentified"), "copies": zero, "n_results": F.lit(1).cast("long")}
    rows = rows.unionByName(results.filter("call_id is null").select("turn", "call_id", "content").withColumns(alone), allowMissingColumns=True)
    kept = ["conversation", "turn", "call_id", "name", "level", "status", "copies", "n_results"]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("valid", T.BooleanType()), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("message", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, why, messages = [], [], []
            for r in batch.to_pylist():
                call, found = None, None
                if r["copies"]:
                    value, found = checked(r["arguments"], schemas.get(r["name"]))
                    call = {"arguments": value, "depends_on": sorted({x for x in r["depends_on"] or [] if x is not None}), "id": r["call_id"], "name": r["name"]}
                result = None if r["content"] is None else {"call_id": r["call_id"], "content": r["content"]}
                valid.append(None if found is None else not found)
                why.append([_encodable(x) for x in found or []])
                messages.append(canonical({"call": call, "result": result}))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(valid, pa.bool_()), pa.array(why, pa.list_(pa.string())), pa.array(messages, pa.string())], names=schema.names)

    return rows.select(*kept, "arguments", "depends_on", "content").mapInArrow(run, schema)


#: The tools that a chat without calls of its own is taken to use: what is asked, and what is set up first.
SCHEMAS = {
    "configure": {"type": "object", "properties": {"instructions": {"type": "string", "minLength": 1}}, "required": ["instructions"], "additionalProperties": False},
    "reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["prompt", "turn", "words"], "additionalProperties": False},
}


def calls_of_chats(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations.

    A system turn configures, a user turn asks and depends on what its conversation begins with; any other turn (of the assistant, a tool, or an
    unknown or null role) answers the turn before. Turns without a number or conversation have null ids.
    """
    chats = chats.select(F.col("conv_id").cast("string").alias("conversation"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def call_id(turn):
        return F.concat(F.lit("call_"), F.col("conversation"), F.lit("_"), turn.cast("string"))

    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    asked = F.to_json(F.struct(F.col("text").alias("prompt"), "turn", words.alias("words")))
    system, calls = F.col("role") == "system", F.col("role").isin("user", "system")
    made = chats.filter(calls).select(
        "conversation",
        "turn",
        call_id(F.col("turn")).alias("call_id"),
        F.when(system, "configure").otherwise("reply").alias("name"),
        F.when(system, F.to_json(F.struct(F.col("text").alias("instructions")))).otherwise(asked).alias("arguments"),
        F.when(F.col("turn") > 0, F.array(call_id(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    return made, chats.filter(~calls).select("turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def query(spark, sf_dir: str) -> DataFrame:
    """The calls of all conversations."""
    calls, results = calls_of_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = link_tool_calls(calls, results, SCHEMAS)
    return found.select("conversation", "turn", "call_id", "name", "level", "status", "copies", "n_results", "valid", F.size("errors").alias("n_errors"), F.sha2("message", 256).alias("message_sha256"))
