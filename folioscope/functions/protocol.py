"""Strict readers of protocol messages, stored values, part names and version lists."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES, VERSION, MOST_DEPTH = 16 << 20, 1, 32


class Twice(ValueError):
    """A key that appears twice in one object."""


def _once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Twice
    return out


def parse_envelope(text: str | None) -> dict:
    """{id, type, payload, error} of a message {v, id, type, payload}: only what the text says, nothing of it in an error.

    error: too_large, invalid (not an object, a field twice or of the wrong type), or version. The payload is kept as JSON;
    without one, or with null, it is the empty object. Unknown fields are ignored.
    """
    bad = lambda why: {"id": None, "type": None, "payload": None, "error": why}
    if text is None:
        return bad("invalid")
    if len(text.encode("utf-8", "replace")) > MOST_BYTES:
        return bad("too_large")
    try:
        message = json.loads(text, object_pairs_hook=_once, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
    except (ValueError, RecursionError):
        return bad("invalid")
    if not isinstance(message, dict) or type(message.get("v")) is not int:
        return bad("invalid")
    if message["v"] != VERSION:
        return bad("version")
    ident, kind, payload = message.get("id"), message.get("type"), message.get("payload")
    if type(ident) is not int or not 0 <= ident < 1 << 63 or not isinstance(kind, str) or not isinstance(payload, dict | None):
        return bad("invalid")
    return {"id": ident, "type": kind, "payload": json.dumps(payload or {}, separators=(",", ":"), ensure_ascii=False), "error": None}


def envelope(text: Column) -> Column:
    @F.arrow_udf("id long, type string, payload string, error string")
    def run(texts: pa.Array) -> pa.Array:
        rows = [parse_envelope(t) for t in texts.to_pylist()]
        return pa.array(rows, pa.struct([("id", pa.int64()), ("type", pa.string()), ("payload", pa.string()), ("error", pa.string())]))

    return run(text)


def json_error(text: str | None) -> str | None:
    """The kind of fault of a JSON text, without a character of it: end, syntax, number or depth; nothing if it is well formed."""
    if text is None or not text.strip():
        return "end"
    try:
        json.loads(text, parse_constant=lambda _: (_ for _ in ()).throw(OverflowError()))
    except OverflowError:
        return "number"
    except RecursionError:
        return "depth"
    except json.JSONDecodeError as error:
        return "end" if error.pos >= len(text.rstrip()) or "Unterminated" in error.msg else "syntax"
    return None


def json_errors(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([json_error(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def depth(value: Column) -> Column:
    """Levels of a value in JSON: 1 for a plain one, one more for each list or map around it. Brackets are counted outside strings."""
    bare = F.regexp_replace(value, r'"(?:[^"\\]|\\.)*"', "0")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[{]|[\]}]|[^\[\]{},:\s]+"), 0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, m: Column) -> Column:
        now = F.when(m.isin("[", "{"), acc["now"] + 1).when(m.isin("]", "}"), acc["now"] - 1).otherwise(acc["now"])
        level = F.when(m.isin("[", "{", "]", "}"), now).otherwise(acc["now"] + 1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], level).alias("most"))

    return F.aggregate(marks, start, step, lambda acc: acc["most"])


def storable(levels: Column) -> Column:
    return levels <= MOST_DEPTH


def part_name_problem(name: Column) -> Column:
    """Why a name is no part name: no slash, empty segment, dot (a segment of dots, or ending with one), escape, character; null if it is one."""
    segments = F.split(F.substring(name, F.lit(2), F.length(name)), "/")
    return (
        F.when(name.isNull() | ~name.startswith("/"), "no slash")
        .when(F.exists(segments, lambda s: s == ""), "empty segment")
        .when(F.exists(segments, lambda s: s.endswith(".")), "dot")
        .when(name.rlike("%(?![0-9A-Fa-f]{2})|%(?:2[Ff]|5[Cc])|%(?:4[1-9A-Fa-f]|5[0-9Aa]|6[1-9A-Fa-f]|7[0-9Aa]|3[0-9]|2[DdEe]|5[Ff]|7[Ee])"), "escape")
        .when(name.rlike(r"[\x00-\x20\"<>\\^`{|}?#\[\]\x7F]"), "character")
    )


def part_name_key(name: Column) -> Column:
    """Names are the same if their keys are: ASCII letters without case."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def added_versions(now: DataFrame, base: DataFrame, at: Column, hours: int = 24) -> DataFrame:
    """(name, version, added, old_enough) of the versions of now (name, version, at) that base lacks; added is their first time."""
    first = now.groupBy("name", "version").agg(F.min("at").alias("added"))
    new = first.join(base.select("name", "version").distinct(), ["name", "version"], "left_anti")
    return new.withColumn("old_enough", F.col("added") + F.expr(f"INTERVAL '{hours}' HOUR") <= at)


def pin_problems(requirements: DataFrame) -> DataFrame:
    """(name, problem) of rows (name, requirement, resolved): exact pins begin with `=` and name the version that was resolved."""
    pinned = F.trim(F.regexp_extract("requirement", r"^=([^=<>~^*]*)$", 1))
    problem = F.when(~F.coalesce(F.col("requirement").startswith("="), F.lit(False)) | (pinned == ""), "not exact").when(~pinned.eqNullSafe(F.col("resolved")), "resolved otherwise")
    return requirements.select("name", problem.alias("problem")).where("problem is not null")
