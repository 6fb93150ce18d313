"""Hashes, identifiers, lists and maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

M64 = (1 << 64) - 1


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def short(digest: Column) -> Column:
    """The first twelve digits, as messages show them."""
    return F.substring(digest, 1, 12)


def object_key(digest: Column) -> Column:
    """Where a content store keeps a document: two digits, then the rest."""
    return F.concat(F.lit("objects/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, F.lit(3), F.lit(62)))


def key_digest(path: Column) -> Column:
    """The digest of an object's path; null of any other path."""
    parts = F.regexp_extract(path, "objects/([0-9a-f]{2})/([0-9a-f]{62})$", 1)
    return F.when(parts != "", F.concat(parts, F.regexp_extract(path, "objects/([0-9a-f]{2})/([0-9a-f]{62})$", 2)))


def _fnv1a(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    for b in data:
        h = (h ^ b) * 0x100000001B3 & M64
    return h


@F.pandas_udf(StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a in 16 hexadecimal digits: a byte-wise multiply in 64 bits, which SQL has no wrapping arithmetic for."""
    return text.map(lambda t: None if t is None else f"{_fnv1a(t.encode()):016x}")


@F.pandas_udf(StringType())
def message_digest(messages: pd.Series) -> pd.Series:
    """FNV-1a over each message of a list and a line feed."""

    def one(items) -> str | None:
        if items is None:
            return None
        h = 0xCBF29CE484222325
        for m in items:
            h = _fnv1a(m.encode() + b"\n", h)
        return f"fnv1a64:{h:016x}"

    return messages.map(one)


def _splitmix(state: int) -> tuple[int, int]:
    state = (state + 0x9E3779B97F4A7C15) & M64
    z = state
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & M64
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & M64
    return state, z ^ (z >> 31)


@F.pandas_udf(StringType())
def derived_id(parent: pd.Series, salt: pd.Series) -> pd.Series:
    """A 128-bit identifier that follows from another and a number."""

    def one(p: str | None, s: int | None) -> str | None:
        if p is None or s is None:
            return None
        state = int(p, 16) & M64 ^ (int(p, 16) >> 64) ^ (int(s) * 0x9E3779B97F4A7C15 & M64)
        state, high = _splitmix(state)
        _, low = _splitmix(state)
        return f"{high:016x}{low:016x}"

    return pd.Series([one(p, s) for p, s in zip(parent, salt, strict=True)], dtype=object)


def list_insert(items: Column, at: Column, value: Column) -> Column:
    """At place `at` from 0, at the end if beyond."""
    at = F.least(F.greatest(at, F.lit(0)), F.size(items))
    return F.concat(F.slice(items, F.lit(1), at), F.array(value), F.slice(items, at + 1, F.size(items)))


def list_remove(items: Column, at: Column) -> Column:
    return F.concat(F.slice(items, F.lit(1), at), F.slice(items, at + 2, F.size(items)))


def list_move(items: Column, source: Column, target: Column) -> Column:
    value = F.element_at(items, source + 1)
    return list_insert(list_remove(items, source), target, value)


def map_set(values: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(key, value))


def map_remove(values: Column, key: Column) -> Column:
    return F.map_filter(values, lambda k, _: k != key)


def range_agrees(ranges: Column, index: Column) -> Column:
    """Whether an index lies in one of the ranges [first, end)."""
    return F.exists(ranges, lambda r: (r["first"] <= index) & (index < r["end"]))
