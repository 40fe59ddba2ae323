"""Filters, sorts and limits over notes with dynamic metadata, compiled to Column expressions.

A metadata value is looked up once a path by an Arrow function that returns a comparable
struct; filters and orders are JVM expressions over it. Exact top-level keys that are
compared with a string are read by the JVM's own JSON reader first.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.markdown import MAX_SAFE_INTEGER, normal, normal_tag, number_text, unique_key

Path = str | Sequence[str]
_MISSING = object()
LOOKUP = "found boolean, rank int, bool boolean, num double, text string, canonical string, scalars array<string>"
BUILTIN = {"title": "title", "path": "path", "inbound": "inbound", "outbound": "outbound"}


@dataclass(frozen=True)
class Equals:
    path: Path
    value: Any


@dataclass(frozen=True)
class Exists:
    path: Path


@dataclass(frozen=True)
class Sort:
    by: Path = "path"
    descending: bool = False
    metadata: bool = False


@dataclass(frozen=True)
class Query:
    filters: Sequence[Equals | Exists] = ()
    tags: Sequence[str] = ()
    sort: Sort = field(default_factory=Sort)
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.limit is not None and (not isinstance(self.limit, int) or not 0 <= self.limit <= MAX_SAFE_INTEGER):
            raise ValueError("a limit is a whole number from 0 on")


def segments(path: Path) -> list[str]:
    return [part.strip() for part in (path.split(".") if isinstance(path, str) else path)]


def value_at(metadata: Any, path: Path) -> Any:
    """The value at a path, or ``_MISSING``: array places by number, keys exactly or else unambiguously."""
    parts = segments(path)
    if not parts or "" in parts:
        return _MISSING
    for part in parts:
        if isinstance(metadata, list):
            if not re.fullmatch(r"0|[1-9]\d*", part) or int(part) >= len(metadata):
                return _MISSING
            metadata = metadata[int(part)]
        elif isinstance(metadata, dict) and (key := unique_key(metadata, part)) is not None:
            metadata = metadata[key]
        else:
            return _MISSING
    return metadata


def canonical(value: Any) -> str:
    """Text of a value that is equal for equal values: keys in normal order, shortest numbers."""
    if isinstance(value, list):
        return f"[{','.join(map(canonical, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=normal)) + "}"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return "null" if value is None else number_text(value)


def _token(value: Any) -> str:
    """A scalar with its type, so that 1, "1", 1.0 and true compare as they should."""
    if isinstance(value, str):
        return "s" + normal(value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return "n-0" if value == 0 and math.copysign(1, value) < 0 else "n" + number_text(value)
    return "c" + canonical(value)


def _scalars(value: Any) -> list[str]:
    if isinstance(value, list):
        return [t for v in value for t in _scalars(v)]
    return [] if isinstance(value, dict) else [_token(value)]


def _found(value: Any) -> dict[str, Any]:
    none = dict.fromkeys(("bool", "num", "text", "canonical"))
    if value is _MISSING:
        return {"found": False, "rank": None, **none, "scalars": []}
    out = {"found": True, **none, "scalars": _scalars(value)}
    if value is None:
        return out | {"rank": 0}
    if isinstance(value, bool):
        return out | {"rank": 1, "bool": value}
    if isinstance(value, (int, float)):
        return out | {"rank": 2, "num": float(value)}
    if isinstance(value, str):
        return out | {"rank": 3, "text": normal(value)}
    return out | {"rank": 4 if isinstance(value, list) else 5, "canonical": normal(canonical(value))}


def lookup(metadata: Column, path: Path) -> Column:
    """The comparable struct of the value at a path of JSON text; null or malformed JSON has no values."""
    parts = segments(path)

    @F.pandas_udf(LOOKUP)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([found_in(t, parts) for t in texts], columns=["found", "rank", "bool", "num", "text", "canonical", "scalars"])

    return read(metadata)


def found_in(text: str | None, parts: Sequence[str]) -> dict[str, Any]:
    try:
        return _found(value_at(json.loads(text), parts) if text else _MISSING)
    except ValueError:
        return _found(_MISSING)


def condition(f: Equals | Exists, value: Column) -> Column:
    if isinstance(f, Exists):
        return value["found"]
    return value["found"] & F.array_contains(value["scalars"], _token(f.value))


def has_tags(tags: Sequence[str], column: str = "tags") -> Column:
    """Every requested tag is there; a blank tag never is."""
    wanted = [normal_tag(t) for t in tags]
    own = normalized_tags(F.coalesce(F.col(column), F.array().cast("array<string>")))
    if "" in wanted:
        return F.lit(False)
    return reduce(and_, [F.array_contains(own, t) for t in wanted], F.lit(True))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _composed(tags: pd.Series) -> pd.Series:
    return tags.map(lambda own: None if own is None else [None if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in own])


def normalized_tags(tags: Column) -> Column:
    """The comparison form of tags: composed, in lower case, without blanks and signs at the ends; ASCII stays in the JVM."""
    whole = F.zip_with(tags, _composed(tags), lambda own, composed: F.coalesce(composed, own))
    return F.transform(whole, lambda t: F.lower(F.regexp_replace(F.trim(t), "^#+", "")))


@F.pandas_udf(T.StringType())
def normal_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normal(t))


def run(notes: DataFrame, query: Query, degrees: DataFrame | None = None) -> DataFrame:
    """The notes that a query asks for, in its order, with ``position`` from 1.

    ``degrees(id, inbound, outbound)`` is joined only if given; it also drops notes that
    are none of the content. Missing sort values come last in both directions; ties go by
    path and scan order.
    """
    rows = notes
    if degrees is not None:
        rows = rows.join(degrees.select("id", "inbound", "outbound"), "id")
    if query.tags:
        rows = rows.filter(has_tags(query.tags))
    for i, f in enumerate(query.filters):
        name = f"__value_{i}"
        rows = rows.withColumn(name, lookup(F.col("metadata"), f.path)).filter(condition(f, F.col(name))).drop(name)
    sort = query.sort
    if not sort.metadata and sort.by not in BUILTIN:
        raise ValueError(f"no field {sort.by!r} to sort by")
    if sort.metadata:
        rows = rows.withColumn("__sort", lookup(F.col("metadata"), sort.by))
        keys = [F.col(f"__sort.{k}") for k in ("rank", "bool", "num", "text", "canonical")]
        order = [F.col("__sort.found").desc(), *[k.desc_nulls_last() if sort.descending else k.asc_nulls_last() for k in keys]]
    else:
        key = F.col(BUILTIN[sort.by])
        key = normal_text(key) if sort.by in ("title", "path") else key
        order = [key.desc_nulls_last() if sort.descending else key.asc_nulls_last()]
    rows = rows.withColumn("__path", normal_text("path"))
    rows = rows.orderBy(*order, F.col("__path"), F.col("scan_ordinal"))
    rows = rows if query.limit is None else rows.limit(query.limit)
    return rows.drop("__sort", "__path")


def typed_literal(text: str) -> Any:
    """A filter value as written: null, true, false, numbers, JSON or quoted strings, else the text."""
    text = text.strip()
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    if len(text) >= 2 and text[0] == text[-1] == "'":
        return text[1:-1]
    if text.startswith('"'):
        return json.loads(text)
    if re.fullmatch(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text):
        number = float(text)
        if number.is_integer() and abs(number) > MAX_SAFE_INTEGER:
            raise ValueError(f"{text} is out of range")
        return int(number) if number.is_integer() else number
    return text
