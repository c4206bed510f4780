"""Shared working storage of the corpus operators, and the columns they have in common."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.sources.scratch import free, save, scratch, shared_dir

__all__ = ["free", "give_back", "save", "scratch", "shared_dir", "text_or_empty"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def give_back() -> None:
    """Return what earlier tasks of this Python worker have freed to the system, before one that keeps large tables."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not every C library has it
        pass
