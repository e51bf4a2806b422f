"""Tool-call linking: calls and results of conversations as canonical JSON.

Messages have ``conv_id, position, kind, call_id, name, arguments, content,
parent_id``.  Calls meet their results in shuffled hash joins by conversation and
identifier, whose build side has one row a key, so that neither a large
conversation nor a call with many results is a hot spot.  A call may name the call
it builds on; depths come from pointer doubling, in as many rounds as the longest
chain has binary digits.  ``ordered`` numbers a conversation's rows by depth, then
position, so that every call comes after the one it builds on: a range partition
of all rows and the rows' counts per partition, however long a conversation is.
Arguments are validated against the JSON schema of the call's name, and each call
with its result is written as one canonical JSON object: sorted keys, no blanks,
characters unescaped.  ``conversations`` joins them to arrays, in pages of
``PAGE`` rows.

Defined cases: a call without result and a result without call are reported,
not dropped; of several results of a call the first by position, then content,
is linked and the number of all is given; several calls with one identifier
are each linked; calls that build on each other in a circle have the status
``cycle``, depth null and the last places; a parent that doesn't exist counts as
none; a null identifier links to nothing; a message of any other kind, or of none,
is reported as it is, with the status ``other``.  Arguments that are no JSON (NaN
and infinite numbers are none), or are nested deeper than Python's parser goes, are
reported as invalid and kept as text; lone surrogates stay escaped; of equal keys
the last counts.  Repeated rows count once; messages without conv_id belong to no
conversation and take no part.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.llm.common import Scratch, partitions, small_batches

KINDS = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
COLUMNS = ["conv_id", "call_id", "position", "depth", "status", "n_results", "errors", "json"]
ROWS_PER_TASK = 1_000_000
PAGE = 1000
SURROGATE = re.compile("[\ud800-\udfff]")


def is_kind(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, KINDS.get(kind, ())) or kind == "integer" and isinstance(value, float) and value.is_integer()


#: The keywords of JSON Schema that are followed, and those that say
#: nothing about a value.
FOLLOWED = {
    "type", "enum", "const", "anyOf", "oneOf", "allOf", "not", "$ref", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "items", "minItems", "maxItems", "uniqueItems", "required", "properties", "additionalProperties", "minProperties", "maxProperties",
}
SILENT = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}


def check_schema(schema: object, where: str = "#") -> None:
    """ValueError for what is no schema or has a keyword that isn't followed."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{where}: no schema")
    unknown = sorted(set(schema) - FOLLOWED - SILENT)
    if unknown:
        raise ValueError(f"{where}: {', '.join(unknown)} not supported")
    for k in ("not", "items", "additionalProperties"):
        if k in schema:
            check_schema(schema[k], f"{where}/{k}")
    for k in ("anyOf", "oneOf", "allOf"):
        for i, x in enumerate(schema.get(k, [])):
            check_schema(x, f"{where}/{k}/{i}")
    for k in ("properties", "$defs", "definitions"):
        for name, x in schema.get(k, {}).items():
            check_schema(x, f"{where}/{k}/{name}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    if not schema.get("$ref", "#").startswith("#"):
        raise ValueError(f"{where}: $ref to another document")


def same(a: object, b: object) -> bool:
    """Equality of JSON values: numbers by value, true and false aren't numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def _referred(root: object, ref: str) -> object:
    found = root
    for step in ref.lstrip("#").strip("/").split("/") if ref.strip("#/") else []:
        step = step.replace("~1", "/").replace("~0", "~")
        found = found[int(step)] if isinstance(found, list) else found[step]
    return found


def _bounds(value: object, schema: dict, where: str) -> list[str]:
    """What a value's size or amount breaks."""
    found = []
    if isinstance(value, str):
        found += [f"{where}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{where}: too long"] * (len(value) > schema.get("maxLength", len(value)))
        found += [f"{where}: pattern"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{where}: too small"] * (value < schema.get("minimum", value) or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"])
        found += [f"{where}: too large"] * (value > schema.get("maximum", value) or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"])
        found += [f"{where}: no multiple"] * ("multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])) != 0)
    elif isinstance(value, list):
        found += [f"{where}: too few"] * (len(value) < schema.get("minItems", 0)) + [f"{where}: too many"] * (len(value) > schema.get("maxItems", len(value)))
        forms = [canonical(x) for x in value] if schema.get("uniqueItems") else []
        found += [f"{where}: repeated"] * (len(set(forms)) < len(forms))
    elif isinstance(value, dict):
        found += [f"{where}: too few"] * (len(value) < schema.get("minProperties", 0)) + [f"{where}: too many"] * (len(value) > schema.get("maxProperties", len(value)))
    return found


def validate(value: object, schema: dict | bool, where: str = "$", root: object = None) -> list[str]:
    """What is wrong with a value by a schema that ``check_schema`` passes.  True
    allows every value, false none; ``$ref`` is within the schema.  No value is of
    a type that JSON schemas don't have."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{where}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_kind(value, k) for k in kinds):
        return [f"{where}: not {' or '.join(map(str, kinds))}"]
    fits = lambda s: not validate(value, s, where, root)
    found = []
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        found.append(f"{where}: not in enum")
    if "const" in schema and not same(value, schema["const"]):
        found.append(f"{where}: not the constant")
    if "$ref" in schema:
        found += validate(value, _referred(root, schema["$ref"]), where, root)
    for s in schema.get("allOf", []):
        found += validate(value, s, where, root)
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        found.append(f"{where}: none of anyOf")
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1:
        found.append(f"{where}: not one of oneOf")
    if "not" in schema and fits(schema["not"]):
        found.append(f"{where}: excluded by not")
    found += _bounds(value, schema, where)
    if isinstance(value, list):
        found += [e for i, x in enumerate(value) for e in validate(x, schema.get("items", True), f"{where}[{i}]", root)]
    elif isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{where}: {k} missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k not in known and more is False:
                found.append(f"{where}: {k} unknown")
            else:
                found += validate(value[k], known.get(k, more), f"{where}.{k}", root)
    return found


def _plain(value: object) -> object:
    """Numbers in one form: whole ones without a point or an exponent."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_plain(x) for x in value]
    if isinstance(value, dict):
        return {k: _plain(x) for k, x in value.items()}
    return value


def canonical(value: object) -> str:
    """One text for equal values: sorted keys, no blanks, numbers in one form."""
    text = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _no_number(text: str):
    raise ValueError(text)


def _finite(text: str) -> float:
    return value if math.isfinite(value := float(text)) else _no_number(text)


def parsed(text: str) -> object:
    """ValueError for what isn't JSON."""
    return json.loads(text, parse_constant=_no_number, parse_float=_finite)


def depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, call_id, depth``: the number of calls that a call builds on,
    one after the other; null in a circle."""
    ids = calls.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("parent_id").alias("parent_id"))
    ids = scratch.keep(ids)
    known = ids.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    ids = ids.where("parent_id IS NOT NULL").join(known.hint("shuffle_hash"), ["conv_id", "parent_id"], "left").unionByName(ids.where("parent_id IS NULL").withColumn("known", F.lit(None).cast("boolean")))
    now = scratch.keep(ids.select("conv_id", "call_id", F.when(F.col("known"), F.col("parent_id")).alias("next"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth")))
    total = now.count()
    reach = 1
    while reach <= 2 * total and not now.where("next IS NOT NULL").isEmpty():
        ahead = now.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("after"), F.col("depth").alias("more"))
        # Calls that have arrived wait outside the join: their next is null, which would be one key.
        then = now.where("next IS NOT NULL").join(ahead.hint("shuffle_hash"), ["conv_id", "next"], "left").select("conv_id", "call_id", F.col("after").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        then = then.unionByName(now.where("next IS NULL").select("conv_id", "call_id", "next", "depth"))
        then = scratch.keep(then)
        scratch.drop(now)
        now, reach = then, 2 * reach
    return now.select("conv_id", "call_id", F.when(F.col("next").isNull(), F.col("depth")).alias("depth"))


def _serialise(schemas: dict[str, dict]):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            status, errors, text = [], [], []
            for r in rows:
                found, arguments = [], None
                if r["other"]:
                    status.append("other")
                    errors.append(found)
                    text.append(canonical({"arguments": r["arguments"], "call_id": r["call_id"], "conv_id": r["conv_id"], "kind": r["kind"], "name": r["name"], "result": r["content"]}))
                    continue
                if r["has_call"]:
                    try:
                        arguments = parsed(r["arguments"]) if r["arguments"] is not None else None
                        schema = schemas.get(r["name"])
                        found = ["$: no schema"] if schema is None else validate(arguments, schema)
                        canonical(arguments)
                    except RecursionError:
                        found, arguments = ["$: nested too deeply"], r["arguments"]
                    except ValueError:
                        found, arguments = ["$: not JSON"], r["arguments"]
                    found = [SURROGATE.sub("?", e) for e in found]
                if not r["has_call"]:
                    status.append("orphan_result")
                elif r["depth"] is None and r["call_id"] is not None:
                    status.append("cycle")
                else:
                    status.append("invalid_arguments" if found else "ok" if r["n_results"] else "no_result")
                errors.append(found)
                text.append(canonical({"arguments": arguments, "call_id": r["call_id"], "conv_id": r["conv_id"], "depth": r["depth"], "name": r["name"], "result": r["content"]}))
            columns = [batch.column(k) for k in ("conv_id", "call_id", "position", "depth")] + [pa.array(status, pa.string()), batch.column("n_results"), pa.array(errors, pa.list_(pa.string())), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, COLUMNS)

    return run


def link(messages: DataFrame, schemas: dict[str, dict], scratch: Scratch | None = None) -> DataFrame:
    """A row for each call, for each result without call and for each message
    of another kind: ``conv_id, call_id, position, depth, status, n_results,
    errors, json``.  A schema with a keyword that isn't followed is an error."""
    for schema in schemas.values():
        check_schema(schema)
    spark = messages.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "chat")
    messages = scratch.keep(messages.where("conv_id IS NOT NULL").distinct())
    calls = messages.where("kind = 'call'").select("conv_id", "call_id", "position", "name", "arguments", "parent_id")
    results = messages.where("kind = 'result'")
    named = results.where("call_id IS NOT NULL")
    # min over (position, content): the first result.
    first = named.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("position", "content")).alias("r"))
    first = scratch.keep(first.select("conv_id", "call_id", "n_results", F.col("r.position").alias("result_position"), F.col("r.content").alias("content")))
    deep = depths(calls, scratch)
    keys = ["conv_id", "call_id"]
    with_id = calls.where("call_id IS NOT NULL").join(first.hint("shuffle_hash"), keys, "left").join(deep.hint("shuffle_hash"), keys, "left")
    none = lambda kind: F.lit(None).cast(kind)
    called = deep.select(*keys)
    lost = first.join(called.hint("shuffle_hash"), keys, "left_anti").unionByName(results.where("call_id IS NULL").select(*keys, F.lit(1).cast("long").alias("n_results"), F.col("position").alias("result_position"), "content"))
    # A null identifier is no key that rows could meet under.
    alone = calls.where("call_id IS NULL").withColumns({"n_results": none("long"), "result_position": none("long"), "content": none("string"), "depth": none("long")})
    lost = lost.withColumns({"position": none("long"), "name": none("string"), "arguments": none("string"), "parent_id": none("string"), "depth": none("long"), "has_call": F.lit(False)})
    every = with_id.unionByName(alone).withColumn("has_call", F.lit(True)).unionByName(lost)
    every = every.select("conv_id", "call_id", F.coalesce("position", "result_position").alias("position"), "depth", F.coalesce("n_results", F.lit(0)).alias("n_results"), "name", "arguments", "content", "has_call", F.lit(False).alias("other"), none("string").alias("kind"))
    other = messages.where("kind IS NULL OR kind NOT IN ('call', 'result')")
    other = other.select("conv_id", "call_id", "position", F.lit(None).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_results"), "name", "arguments", "content", F.lit(False).alias("has_call"), F.lit(True).alias("other"), "kind")
    return every.unionByName(other).mapInArrow(_serialise(schemas), "conv_id long, call_id string, position long, depth long, status string, n_results long, errors array<string>, json string")


def _numbers(batches):
    """The rows of a sorted partition with their places among its rows of the
    same conversation."""
    last, n = None, 0
    for batch in batches:
        ids = np.asarray(batch.column("conv_id"))
        if not len(ids):
            continue
        new = np.flatnonzero(np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]]))
        begin = np.zeros(len(ids), np.int64)
        begin[new] = new
        place = np.arange(len(ids)) - np.maximum.accumulate(begin)
        place[: new[0] if len(new) else len(ids)] += n
        last, n = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "inner"])


def ordered(linked: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``link`` with ``place``: 1, 2, ... within each conversation,
    calls after those they build on."""
    spark = linked.sparkSession
    scratch = scratch or Scratch(spark, "order")
    rows = scratch.keep(linked)
    last = F.coalesce("depth", F.when(F.col("status") == "cycle", F.lit((1 << 62))).otherwise(F.lit(0))).alias("last")
    order = ["conv_id", last, "position", "call_id", "json"]
    n = partitions(spark, rows.count(), ROWS_PER_TASK)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{k} {t}" for k, t in dealt.dtypes)
    dealt = scratch.keep(dealt.mapInArrow(_numbers, f"{kinds}, inner long"))
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    # A conversation has at most one row here for each partition.
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("conv_id").orderBy("part")) - F.col("n")).where("before > 0").select("conv_id", "part", "before")
    placed = dealt.join(before, ["conv_id", "part"], "left")
    return placed.select(*linked.columns, (F.coalesce("before", F.lit(0)) + F.col("inner") + 1).alias("place"))


def conversations(placed: DataFrame, page: int = PAGE) -> DataFrame:
    """``conv_id, page, n, json``: each conversation's rows in order as one
    canonical array, or as several where there are over ``page`` rows."""
    rows = placed.groupBy("conv_id", F.floor((F.col("place") - 1) / page).alias("page")).agg(F.sort_array(F.collect_list(F.struct("place", "json"))).alias("rows"))
    return rows.select("conv_id", "page", F.size("rows").cast("long").alias("n"), F.concat(F.lit("["), F.array_join("rows.json", ","), F.lit("]")).alias("json"))


#: What a user's turn asks of the assistant, as a call.
REPLY = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def turns_as_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as calls and results: a user's turn calls the tool
    ``reply``, the assistant's next turn is its result, and a user's turn builds
    on the call that the turn before answers.  Turns of any other role, or of
    none, are messages of the kind ``turn`` with the role as their name."""
    turn = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("position"), F.col("role").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    answered = rows.where("role = 'assistant'").select("conv_id", (F.col("position") + 1).alias("position")).distinct().withColumn("answered", F.lit(True))
    calls = rows.where("role = 'user'").join(answered, ["conv_id", "position"], "left")
    arguments = F.to_json(F.struct("text", F.col("position").alias("turn")), {"ignoreNullFields": "false"})
    calls = calls.select("conv_id", "position", F.lit("call").alias("kind"), name(F.col("position")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.lit(None).cast("string").alias("content"), F.when(F.col("answered"), name(F.col("position") - 2)).alias("parent_id"))
    none = F.lit(None).cast("string")
    results = rows.where("role = 'assistant'").select("conv_id", "position", F.lit("result").alias("kind"), name(F.col("position") - 1).alias("call_id"), none.alias("name"), none.alias("arguments"), F.col("text").alias("content"), none.alias("parent_id"))
    other = rows.where("role IS NULL OR role NOT IN ('user', 'assistant')")
    other = other.select("conv_id", "position", F.lit("turn").alias("kind"), none.alias("call_id"), F.col("role").alias("name"), none.alias("arguments"), F.col("text").alias("content"), none.alias("parent_id"))
    return calls.unionByName(results).unionByName(other)
