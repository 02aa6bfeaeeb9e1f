"""Tool-call linking for chat formatting.

Messages become events: tool calls, tool results and plain messages. Calls and results are
joined by conversation and identifier, ordered topologically (a result after its call, a call
after the results of the calls it depends on), arguments are checked against the tools'
schemas, and every event is written as one line of canonical JSON (sorted keys, no spaces).

Order within a conversation: ``anchor`` (the turn, moved back until no dependency is later),
``level`` (depth in the dependency graph), ``turn``, ``part``. No conversation is collected
anywhere, so one of any length is linked by the same joins.

Defined results: a null conversation links nothing, a null turn sorts first; null and empty
texts are messages with that content; texts of any length are read whole; of several calls
with one identifier the first by turn, part and hash of its line counts and later ones are
``duplicate``; further results are ``extra``; rows that are equal throughout tie in that order
and share one status; results without a call are ``orphan``; calls in a dependency cycle keep
level null and status ``cycle``; an empty table gives none; other columns of the table are not
read, so they may have any name. JSON that is broken, nested too deeply to be read, or holds a
number that is not finite (NaN, 1e999) makes a plain message (a call's argument text: a string);
half of a surrogate pair is written as U+FFFD.

Calls and results whose identifier is missing or null link nothing (``unidentified``), and a null among
a call's dependencies names no call.

Chains of calls with one dependency each are levelled by pointer jumping, in a logarithm of their length;
calls with several take a round for each of them on the longest path.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm.shared import cut, drop_cut

EVENTS = "conv_id bigint, turn bigint, part int, kind string, call_id string, valid boolean, problems string, line string, depends_on array<string>"

#: The tool that an exchange without explicit calls stands for.
REPLY_SCHEMA = {
    "type": "object",
    "required": ["prompt", "turn"],
    "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
}

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}


def canonical(value: Any) -> str:
    """Canonical JSON: sorted keys, no spaces, text unescaped, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(literal: str) -> float:
    value = float(literal)
    if not math.isfinite(value):
        raise ValueError(f"not a finite number: {literal}")
    return value


def parsed(text: str) -> Any:
    """JSON text as Python values; ``ValueError`` for whatever canonical JSON can't hold."""
    try:
        return json.loads(text, parse_float=_finite, parse_constant=_finite)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def _sound(value: Any) -> Any:
    """Strings (and lists of them) without halves of surrogate pairs."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return [_sound(x) for x in value] if isinstance(value, list) else value


def problems(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What breaks ``schema`` (type, enum, bounds, lengths, required, properties, items)."""
    kinds = schema.get("type")
    if kinds and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: not {kinds}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not in enum")
    if _TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{path}: under {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{path}: over {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{path}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            found.append(f"{path}: too long")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += problems(item, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for key in sorted(value):
            if key in known:
                found += problems(value[key], known[key], f"{path}.{key}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{path}.{key}: unknown")
    return found


def _explicit(text: str | None) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        found = parsed(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and ("tool_calls" in found or "tool_call_id" in found) else None


def _text(value: Any) -> str | None:
    """A name or identifier as text; null stays null."""
    return None if value is None else str(value)


def _call(ids: tuple, part: int, call: dict, schemas: dict[str, dict]) -> tuple:
    arguments = call.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = parsed(arguments)
        except ValueError:
            pass
    name, call_id = _text(call.get("name")), _text(call.get("id"))
    wrong = problems(arguments, schemas[name]) if name in schemas else [f"no tool {name}"]
    line = canonical({"type": "call", "id": call_id, "name": name, "arguments": arguments})
    needs = call.get("depends_on")
    return (*ids, part, "call", call_id, not wrong, "; ".join(wrong) or None, line, [_text(x) for x in needs if x is not None] if isinstance(needs, list) else [])


def message_events(conv: int | None, turn: int | None, role: str | None, text: str | None, schemas: dict[str, dict], exchanges: bool) -> list[tuple]:
    """The events of one message; a value that can be read but is too deep to be checked or written makes it plain."""
    try:
        found = _events(conv, turn, role, text, schemas, exchanges)
    except RecursionError:
        found = [(conv, turn, 0, "message", None, True, None, canonical({"type": "message", "role": role, "content": text}), [])]
    return [tuple(map(_sound, event)) for event in found]


def _events(conv: int | None, turn: int | None, role: str | None, text: str | None, schemas: dict[str, dict], exchanges: bool) -> list[tuple]:
    ids, found = (conv, turn), _explicit(text)
    if found is not None and isinstance(found.get("tool_calls"), list):
        return [_call(ids, i, c if isinstance(c, dict) else {}, schemas) for i, c in enumerate(found["tool_calls"])]
    if found is not None and "tool_call_id" in found:
        call_id = _text(found["tool_call_id"])
        return [(*ids, 0, "result", call_id, True, None, canonical({"type": "result", "id": call_id, "content": found.get("content")}), [])]
    if exchanges and None not in ids and role == "user":
        return [_call(ids, 0, {"id": f"{conv}:{turn}", "name": "reply", "arguments": {"prompt": text, "turn": turn}}, schemas)]
    if exchanges and None not in ids and role == "assistant":
        call_id = f"{conv}:{turn - 1}"
        return [(*ids, 0, "result", call_id, True, None, canonical({"type": "result", "id": call_id, "content": text}), [])]
    return [(*ids, 0, "message", None, True, None, canonical({"type": "message", "role": role, "content": text}), [])]


def events(messages: DataFrame, schemas: dict[str, dict], *, exchanges: bool) -> DataFrame:
    """The events of a message table (conv_id, turn, role, text).

    With ``exchanges`` a user turn without explicit calls is a call of the tool ``reply``, and
    the assistant turn after it is that call's result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
        names = [f.split(" ")[0] for f in EVENTS.split(", ")]
        for batch in batches:
            rows = [e for m in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in message_events(*m, schemas, exchanges)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    typed = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return typed.mapInArrow(run, EVENTS)


def _jumped(chain: DataFrame) -> DataFrame:
    """``(conv_id, call_id, pointer, weight, anchor)``: calls with one dependency, pointed past all others of their kind.

    A round lets each pointer jump as far again, so a chain takes a logarithm of its length. What
    still moves after that is in, or leads into, a cycle and is left out.
    """
    chain = cut(chain, "op4-chain")
    rounds = chain.count().bit_length() + 1
    while True:
        ahead = chain.select("conv_id", F.col("call_id").alias("pointer"), F.col("pointer").alias("further"), F.col("weight").alias("more"), F.col("anchor").alias("later"))
        joined = chain.join(ahead, ["conv_id", "pointer"], "left")
        moved = joined.select("conv_id", "call_id", F.coalesce("further", "pointer").alias("pointer"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"), F.greatest("anchor", "later").alias("anchor"), F.col("further").isNotNull().alias("moves"))
        chain, before = cut(moved, "op4-chain"), chain
        drop_cut(before)
        rounds -= 1
        if rounds < 0 or chain.where("moves").limit(1).count() == 0:
            return chain.where("NOT moves").drop("moves")


def _levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, anchor, level)`` of the calls; those in a cycle, or behind one, are missing."""
    needs = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("depends_on")).alias("needed"))
    ids = calls.select("conv_id", F.col("call_id").alias("needed"))
    known = cut(needs.join(ids, ["conv_id", "needed"], "left_semi"), "op4-needs")
    degree = known.groupBy("conv_id", "call_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("pointer"))
    sources = calls.join(known.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.col("turn").alias("anchor"), F.lit(0).alias("level"))
    if known.limit(1).count() == 0:
        return sources
    jumped = _jumped(degree.where("n = 1").select("conv_id", "call_id", "pointer", F.lit(2).alias("weight"), F.col("turn").alias("anchor")))
    done = sources
    past = jumped.select("conv_id", F.col("call_id").alias("needed"), F.col("pointer").alias("root"), F.col("weight").alias("more"), F.col("anchor").alias("later"))
    several = known.join(degree.where("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi").join(past, ["conv_id", "needed"], "left")
    edges = cut(several.select("conv_id", "call_id", F.coalesce("root", "needed").alias("root"), (F.coalesce("more", F.lit(0)) + 2).alias("weight"), F.greatest("turn", "later").alias("own"), F.lit(None).cast("bigint").alias("anchor"), F.lit(None).cast("int").alias("level")), "op4-edges")
    fresh = sources
    while edges.limit(1).count():  # a round for each call with several dependencies on the longest path
        found = fresh.select("conv_id", F.col("call_id").alias("root"), F.col("anchor").alias("later"), F.col("level").alias("found"))
        told, before = cut(edges.join(found, ["conv_id", "root"], "left").select("conv_id", "call_id", "root", "weight", "own", F.coalesce("anchor", "later").alias("anchor"), F.coalesce("level", "found").alias("level")), "op4-edges"), edges
        drop_cut(before)
        ready = told.groupBy("conv_id", "call_id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.greatest("own", "anchor")).alias("anchor"), F.max(F.col("level") + F.col("weight")).alias("level")).where("open = 0").drop("open")
        fresh = cut(ready, "op4-levels")
        if fresh.limit(1).count() == 0:
            break
        done = done.unionByName(fresh)
        edges = told.join(fresh.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    ends = done.select("conv_id", F.col("call_id").alias("pointer"), F.col("anchor").alias("later"), "level")
    chained = jumped.join(ends, ["conv_id", "pointer"]).select("conv_id", "call_id", F.greatest("anchor", "later").alias("anchor"), (F.col("level") + F.col("weight")).alias("level"))
    return done.unionByName(chained)


def link(found: DataFrame) -> DataFrame:
    """Events with ``anchor``, ``level`` and ``status``."""
    place = F.struct("turn", "part", F.xxhash64("line").alias("tie"))
    keyed = found.where("conv_id IS NOT NULL AND call_id IS NOT NULL").withColumn("place", place)
    firsts = keyed.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", F.col("place"))).alias("first_call"),
        F.min(F.when(F.col("kind") == "result", F.col("place"))).alias("first_result"),
    )
    calls = keyed.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min_by(F.struct("turn", "depends_on"), "place").alias("c")).select("conv_id", "call_id", "c.turn", "c.depends_on")
    placed = firsts.join(_levels(calls), ["conv_id", "call_id"], "left")
    joined = keyed.join(placed.hint("shuffle_hash"), ["conv_id", "call_id"])
    is_call = F.col("kind") == "call"
    status = (
        F.when(is_call & (F.col("place") != F.col("first_call")), "duplicate")
        .when(F.col("first_call").isNull(), "orphan")
        .when(F.col("level").isNull(), "cycle")
        .when(is_call, F.when(F.col("first_result").isNull(), "unanswered").otherwise("linked"))
        .when(F.col("place") != F.col("first_result"), "extra")
        .otherwise("linked")
    )
    linked = joined.select("conv_id", "turn", "part", F.greatest("turn", "anchor").alias("anchor"), F.when(is_call, F.col("level")).otherwise(F.coalesce(F.col("level") + 1, F.lit(0))).alias("level"), "kind", "call_id", status.alias("status"), "valid", "problems", "line")
    alone = found.where("conv_id IS NULL OR call_id IS NULL").select("conv_id", "turn", "part", F.col("turn").alias("anchor"), F.lit(0).alias("level"), "kind", "call_id", F.when((F.col("kind") != "message") & F.col("call_id").isNull(), "unidentified").otherwise("message").alias("status"), "valid", "problems", "line")
    return linked.unionByName(alone)


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None, *, exchanges: bool = True) -> DataFrame:
    """Linked, ordered and serialised events of every message."""
    return link(events(messages, {"reply": REPLY_SCHEMA, **(schemas or {})}, exchanges=exchanges))


ORACLE = r"""
WITH event AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id,
    coalesce(role <> 'user' OR (length(text) > 0 AND turn >= 0), false) AS valid,
    CASE role WHEN 'user' THEN '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"id":"' || conv_id || ':' || turn || '","name":"reply","type":"call"}'
      WHEN 'assistant' THEN '{"content":' || to_json(text) || ',"id":"' || conv_id || ':' || (turn - 1) || '","type":"result"}'
      ELSE '{"content":' || to_json(text) || ',"role":"' || role || '","type":"message"}' END AS line
  FROM conversations),
call AS (SELECT call_id, min(turn) AS turn FROM event WHERE kind = 'call' GROUP BY call_id),
result AS (SELECT call_id, min(turn) AS turn FROM event WHERE kind = 'result' GROUP BY call_id)
SELECT e.conv_id, e.turn, 0 AS part, greatest(e.turn, coalesce(c.turn, e.turn)) AS anchor,
  CASE WHEN e.kind = 'result' AND c.turn IS NOT NULL THEN 1 ELSE 0 END AS level, e.kind, e.call_id,
  CASE WHEN e.kind = 'message' THEN 'message' WHEN e.kind = 'call' AND e.turn <> c.turn THEN 'duplicate' WHEN c.turn IS NULL THEN 'orphan'
    WHEN e.kind = 'call' THEN CASE WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END WHEN e.turn <> r.turn THEN 'extra' ELSE 'linked' END AS status,
  e.valid, CAST(NULL AS VARCHAR) AS problems, e.line
FROM event e LEFT JOIN call c ON e.call_id = c.call_id LEFT JOIN result r ON e.call_id = r.call_id
"""
