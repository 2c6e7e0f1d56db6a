"""Tool-call linking for chat transcripts.

Messages are rows (conversation, turn, role, text). A text that is a JSON object with ``tool_calls`` (a list of id, name,
arguments and, optionally, depends_on ids) makes calls; a message of role ``tool`` whose text is a JSON object with
``tool_call_id`` is a result. Arguments that hold ``{"$ref": id}`` depend on that call's result. Calls and results are
linked by a hash join on conversation and identifier, ordered topologically, validated against JSON schemas and written
as canonical JSON (sorted keys, no blanks, UTF-8).

Output is one row an event, not one a conversation: sorted by (conversation, ready, depth, turn, place) the events are in
topological order. So a conversation of any length is never gathered in one task.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.runtime import bound_batches, materialise, release

_EVENT = "array<struct<place:int,kind:string,call_id:string,name:string,refs:array<string>,valid:boolean,error:string,json:string>>"


_LONE = re.compile("[\ud800-\udfff]")


def _written(text: str | None) -> str | None:
    """``text`` with lone surrogates, which UTF-8 cannot hold, written as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text) if text else text


def canonical(value: Any) -> str:
    """JSON with sorted keys and without blanks; whole floats are written as integers, lone surrogates as escapes.

    ValueError for infinite numbers and those that are none.
    """

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return _written(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _finite(digits: str) -> float:
    if math.isinf(x := float(digits)):
        raise ValueError("number beyond a double's range")
    return x


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def schema_error(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first breach of a JSON schema (type, enum, required, properties, additionalProperties, items, bounds)."""
    kinds = schema.get("type")
    if kinds is not None:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        fits = lambda k: (number and (k == "number" or isinstance(value, int) or value.is_integer())) if k in ("number", "integer") else isinstance(value, _TYPES.get(k, object))
        if not any(fits(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return f"{at}: not of type {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of bounds"
    if isinstance(value, dict):
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}: {k} is missing"
        known = schema.get("properties", {})
        for k, v in sorted(value.items()):
            if k in known:
                if error := schema_error(v, known[k], f"{at}.{k}"):
                    return error
            elif schema.get("additionalProperties") is False:
                return f"{at}: {k} is not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            if error := schema_error(v, schema["items"], f"{at}[{i}]"):
                return error
    return None


def _refs(value: Any) -> set[str]:
    if isinstance(value, dict):
        own = {str(value["$ref"])} if isinstance(value.get("$ref"), str) else set()
        return own.union(*(_refs(v) for v in value.values()))
    return set().union(*(_refs(v) for v in value)) if isinstance(value, list) else set()


def _object(text: str | None) -> dict | None:
    if text is None or not text.lstrip()[:1] == "{":
        return None
    try:
        got = json.loads(text, parse_float=_finite, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def events_of(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[dict]:
    """The events of one message; a call without an id or a name is invalid.

    Broken JSON is ordinary text, as are NaN, infinities, numbers beyond a double's range or of over 4,300 digits, and
    nesting deeper than Python's stack; in arguments that come as a string they make the call invalid.
    """
    try:
        return [e | {k: _written(e[k]) for k in ("call_id", "name", "error")} | {"refs": [_written(r) for r in e["refs"]]} for e in _events(role, text, schemas, _object(text))]
    except RecursionError:
        return _events(role, text, schemas, None)


def _events(role: str | None, text: str | None, schemas: dict[str, dict], got: dict | None) -> list[dict]:
    blank = {"place": 0, "call_id": None, "name": None, "refs": [], "valid": None, "error": None}
    if got is not None and role == "tool" and isinstance(got.get("tool_call_id"), str):
        return [blank | {"kind": "result", "call_id": got["tool_call_id"], "json": canonical({"role": "tool", **got})}]
    if got is None or not isinstance(got.get("tool_calls"), list):
        return [blank | {"kind": "message", "json": canonical({"role": role, "content": text})}]
    out = []
    if got.get("content") is not None:
        out.append(blank | {"kind": "message", "json": canonical({"role": role, "content": got["content"]})})
    for call in got["tool_calls"]:
        call = call if isinstance(call, dict) else {}
        args, name, number = call.get("arguments"), call.get("name"), call.get("id")
        if isinstance(args, str):  # arguments may come as a JSON string
            args = _object(args)
        named = isinstance(name, str) and isinstance(number, str)
        error = "no id or name" if not named else "unknown tool" if name not in schemas else "arguments are no object" if not isinstance(args, dict) else schema_error(args, schemas[name])
        wants = [x for x in call["depends_on"] if isinstance(x, str)] if isinstance(call.get("depends_on"), list) else []
        out.append(blank | {
            "kind": "call", "place": len(out), "call_id": number if isinstance(number, str) else None, "name": name if isinstance(name, str) else None,
            "refs": sorted(_refs(args) | set(wants)), "valid": error is None, "error": error, "json": canonical({"role": role, "id": number, "name": name, "arguments": args}),
        })
    return out or [blank | {"kind": "message", "json": canonical({"role": role, "content": text})}]


def link(messages: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Events: (conv, turn, place, kind, call_id, name, status, error, ready, depth, json).

    status: of calls linked, unanswered, invalid, repeated (an earlier call has the id) or cycle; of results linked or
    orphan; else null. ``ready`` is the latest turn that an event or what it depends on has, ``depth`` its place in the
    chain. Null texts are null contents; null conversations, turns and ids are kept and linked to nothing; repeated
    messages stay, and their calls count as repeated; an empty table gives no rows.
    """
    spark = messages.sparkSession
    bound_batches(spark)
    known = dict(schemas or {})

    @F.pandas_udf(_EVENT)
    def parse(roles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([events_of(r, t, known) for r, t in zip(roles, texts, strict=True)], dtype=object)

    told = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.explode(parse(F.col(role_col), F.col(text_col))).alias("e"))
    flat, _ = materialise(told.select("conv", "turn", "e.*"), "chat-events")
    calls = flat.where("kind = 'call' and call_id is not null and conv is not null")
    first = calls.groupBy("conv", "call_id").agg(F.min_by(F.struct("turn", "place", "json", "valid", "refs"), F.struct("turn", "place", "json")).alias("c"), F.count("*").alias("n"))
    results = flat.where("kind = 'result' and conv is not null").groupBy("conv", "call_id").agg(F.max("turn").alias("answered"))
    nodes = first.join(results, ["conv", "call_id"], "left").select("conv", "call_id", "c.turn", "c.place", "c.json", "c.refs", "answered")
    ready = _ready(nodes)
    joined = flat.join(ready, ["conv", "call_id"], "left")
    same = (F.col("turn") == F.col("first_turn")) & (F.col("place") == F.col("first_place")) & (F.col("json") == F.col("first_json"))
    status = (
        F.when((F.col("kind") == "call") & F.col("call_id").isNull(), "invalid")
        .when((F.col("kind") == "call") & ~F.coalesce(same, F.lit(False)), "repeated")
        .when((F.col("kind") == "call") & F.col("cycle"), "cycle")
        .when((F.col("kind") == "call") & ~F.col("valid"), "invalid")
        .when((F.col("kind") == "call") & F.col("answered").isNull(), "unanswered")
        .when(F.col("kind") == "call", "linked")
        .when((F.col("kind") == "result") & F.col("first_turn").isNull(), "orphan")
        .when(F.col("kind") == "result", "linked")
    )
    at = F.when(F.col("kind") == "message", F.col("turn")).otherwise(F.greatest("turn", "ready"))
    depth = F.when(F.col("kind") == "message", 0).otherwise(F.coalesce(F.col("level"), F.lit(0)) * 2 + F.when(F.col("kind") == "result", 1).otherwise(0))
    return joined.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "place", "kind", "call_id", "name", status.alias("status"), "error", at.alias("ready"), depth.cast("int").alias("depth"), "json")


def _ready(nodes: DataFrame) -> DataFrame:
    """Kahn's layers over the calls: a call's turn is at least that of the results that it depends on.

    Calls with one reference are first tied to the nearest call before them that has none or several, by path doubling;
    only calls with several references take part in the rounds. Those left when nothing moves are in or behind a cycle.
    """
    spark = nodes.sparkSession
    names = ["conv", "call_id", "first_turn", "first_place", "first_json", "answered"]
    base = nodes.select("conv", "call_id", F.col("turn").alias("first_turn"), F.col("place").alias("first_place"), F.col("json").alias("first_json"), "answered", "refs")
    base, _ = materialise(base, "chat-calls")
    links = base.select("conv", "call_id", F.explode(F.array_distinct("refs")).alias("ref"))
    real = links.join(base.select("conv", F.col("call_id").alias("ref")), ["conv", "ref"], "left_semi")
    links, _ = materialise(real, "chat-links")
    waiting = links.groupBy("conv", "call_id").agg(F.count("*").alias("n"))
    roots = base.join(waiting, ["conv", "call_id"], "left_anti")
    if links.isEmpty():
        return roots.select(*names, F.col("first_turn").alias("ready"), F.lit(0).alias("level"), F.lit(False).alias("cycle"))
    hops = _hops(base, links.join(waiting.where("n = 1"), ["conv", "call_id"], "left_semi"))
    # a reference to a call of the paths becomes one to the path's start, so many layers on and at least at ``seen``
    own = base.select("conv", F.col("call_id").alias("ref"), F.greatest("first_turn", "answered").alias("own"))
    several = links.join(waiting.where("n > 1"), ["conv", "call_id"], "left_semi").join(own, ["conv", "ref"])
    over = several.join(hops.withColumnRenamed("call_id", "ref"), ["conv", "ref"], "left")
    told = over.select("conv", "call_id", F.coalesce("to", "ref").alias("to"), F.coalesce("far", F.lit(0)).alias("far"), F.greatest("own", "seen").alias("seen"))
    far, _ = materialise(told, "chat-far")
    done, done_path = materialise(roots.select("conv", "call_id", F.col("first_turn").alias("ready"), "answered", F.lit(0).alias("level")), "chat-done")
    while True:
        known = done.select("conv", F.col("call_id").alias("to"), F.greatest("ready", "answered").alias("at"), "level")
        counted = far.join(done, ["conv", "call_id"], "left_anti").join(known, ["conv", "to"], "left").groupBy("conv", "call_id")
        free = counted.agg(F.max(F.greatest("at", "seen")).alias("at"), F.max(F.col("level") + F.col("far") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        fresh = base.join(free, ["conv", "call_id"]).select("conv", "call_id", F.greatest("first_turn", "at").alias("ready"), "answered", "level")
        fresh, fresh_path = materialise(fresh, "chat-fresh")
        if fresh.isEmpty():
            break
        merged, merged_path = materialise(done.union(fresh), "chat-done")
        release(spark, fresh_path, done_path)
        done, done_path = merged, merged_path
    start = done.select("conv", F.col("call_id").alias("to"), F.greatest("ready", "answered").alias("at"), F.col("level").alias("l"))
    along = hops.join(start, ["conv", "to"]).select("conv", "call_id", F.greatest("at", "seen").alias("ready"), (F.col("l") + F.col("far")).alias("level"))
    placed = done.select("conv", "call_id", "ready", "level").union(along)
    every = base.join(placed, ["conv", "call_id"], "left")
    return every.select(*names, F.greatest("first_turn", "ready").alias("ready"), F.coalesce("level", F.lit(0)).alias("level"), F.col("level").isNull().alias("cycle"))


def _hops(base: DataFrame, singles: DataFrame) -> DataFrame:
    """(conv, call_id, to, far, seen) of calls with one reference, by path doubling.

    ``to`` is the first call on the path that has no or several references, ``far`` steps off, ``seen`` the latest turn of
    the calls and results between. On a path that ends in a cycle ``to`` stays a call with one reference.
    """
    spark = base.sparkSession
    own = base.select("conv", "call_id", F.greatest("first_turn", "answered").alias("own"))
    hops = singles.join(own, ["conv", "call_id"]).select("conv", "call_id", F.col("ref").alias("to"), F.lit(1).alias("far"), F.lit(None).cast("long").alias("seen"), "own")
    hops, path = materialise(hops, "chat-hops")
    for _ in range(hops.count().bit_length()):
        ahead = hops.select("conv", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.greatest("own", "seen").alias("seen2"))
        if hops.join(ahead, ["conv", "to"], "left_semi").isEmpty():
            break
        further = F.coalesce(F.col("far2"), F.lit(0))
        moved = hops.join(ahead, ["conv", "to"], "left").select("conv", "call_id", F.coalesce("to2", "to").alias("to"), (F.col("far") + further).alias("far"), F.greatest("seen", "seen2").alias("seen"), "own")
        moved, moved_path = materialise(moved, "chat-hops")
        release(spark, path)
        hops, path = moved, moved_path
    return hops.drop("own")
