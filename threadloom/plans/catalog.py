"""Gathers the query modules."""

from __future__ import annotations

from threadloom.plans import block_queries, extension_queries, selection_queries, service_queries, thread_queries, vector_queries  # noqa: F401  they register themselves
from threadloom.plans.registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracles():
    return ORACLES
