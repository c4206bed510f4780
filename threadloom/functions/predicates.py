"""A small predicate tree that compiles to one Catalyst column.

The tree is data, so a plan can look into it (``thread_scope_of``), while filtering is a single
expression that the optimizer pushes to the scan. Exclusion sets given as DataFrames become anti
joins in ``apply``, which also leaves null ids alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class InThread:
    thread: Any


@dataclass(frozen=True)
class InScope:
    """``everywhere`` or only the current thread."""

    everywhere: bool
    current: Any = None


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class HasMetadata:
    """A missing key reads as the empty string; ``thread_id`` is the thread itself."""

    key: str
    value: str


@dataclass(frozen=True)
class Excluding:
    ids: tuple = field(default_factory=tuple)


def column(p, thread: str = "thread_id", message: str = "message_id", metadata: str = "metadata") -> Column:
    """The tree as a boolean column; None is true, and an unknown node is false."""
    own = lambda x: column(x, thread, message, metadata)
    match p:
        case None | All():
            return F.lit(True)
        case InThread(t):
            return F.col(thread).eqNullSafe(F.lit(t))
        case InScope(everywhere, current):
            return F.lit(True) if everywhere else F.col(thread).eqNullSafe(F.lit(current))
        case And(parts):
            return reduce(Column.__and__, map(own, parts), F.lit(True))
        case Or(parts):
            return reduce(Column.__or__, map(own, parts), F.lit(False))
        case Not(part):
            return ~own(part)
        case HasMetadata("thread_id", value):
            return F.col(thread).eqNullSafe(F.lit(value))
        case HasMetadata(key, value):
            return F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit("")) == value
        case Excluding(ids):
            return ~F.coalesce(F.col(message).isin(list(ids)), F.lit(False)) if ids else F.lit(True)
    return F.lit(False)


def evaluate(p, row: dict) -> bool:
    """The same meaning for one row, for tests."""
    match p:
        case None | All():
            return True
        case InThread(t):
            return row["thread_id"] == t
        case InScope(everywhere, current):
            return everywhere or row["thread_id"] == current
        case And(parts):
            return all(evaluate(x, row) for x in parts)
        case Or(parts):
            return any(evaluate(x, row) for x in parts)
        case Not(part):
            return not evaluate(part, row)
        case HasMetadata(key, value):
            return (row["thread_id"] if key == "thread_id" else (row.get("metadata") or {}).get(key, "")) == value
        case Excluding(ids):
            return row["message_id"] not in ids
    return False


def thread_scope_of(p):
    """The thread that a conjunction pins, or None; a filter on it prunes partitions."""
    match p:
        case InThread(t):
            return t
        case InScope(False, current):
            return current
        case And(parts):
            return next((t for t in map(thread_scope_of, parts) if t is not None), None)
    return None


def apply(df: DataFrame, p, excluded: DataFrame | None = None, **names: str) -> DataFrame:
    """Rows of ``df`` that satisfy ``p`` and whose id is not in ``excluded`` (its first column)."""
    out = df.filter(column(p, **names))
    if excluded is None:
        return out
    key = names.get("message", "message_id")
    return out.join(excluded.select(F.col(excluded.columns[0]).alias(key)), key, "left_anti")
