"""Checks of settings that are stored as JSON objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setting:
    """A key, whether its value is a whole number, whether it must be there, and its least and greatest value."""

    key: str
    whole: bool
    required: bool
    least: float
    most: float = float("inf")


#: The knobs of the engine, and keys of older files that are passed over.
ENGINE = (
    Setting("loss_ratio", False, False, 0, 1),
    Setting("min_batch_stddev", False, True, 0),
    Setting("local_context_size", True, True, 1),
    Setting("rerank_top_k", True, True, 1),
    Setting("context_budget_tokens", True, True, 0),
    Setting("budget_headroom_pct", False, True, 0, 1),
    Setting("per_msg_delimiter_tokens", True, True, 0),
)
RETIRED = ("diversity_lambda",)


def problems(stored: DataFrame, key: str, column: str, schema: tuple[Setting, ...] = ENGINE, retired: tuple[str, ...] = RETIRED) -> DataFrame:
    """A row ``key, setting, problem`` for all that is wrong with each stored object; sound ones have none.

    Problems: ``not an object`` (null, broken JSON or another value; the setting is null then),
    ``unknown``, ``missing``, ``wrong type`` and ``out of range``. A null value counts as 0 where
    it is given. Whole numbers have no fraction.
    """
    parsed = F.try_parse_json(F.col(column))
    names = F.json_object_keys(F.col(column))
    rows = stored.select(F.col(key), parsed.alias("_v"), F.when(F.schema_of_variant(parsed).startswith("OBJECT"), names).alias("_names"))
    found = lambda setting, problem: F.struct(setting.cast("string").alias("setting"), F.lit(problem).alias("problem"))
    known = F.lit([s.key for s in schema] + list(retired))
    parts = [F.transform(F.array_except("_names", known), lambda n: found(n, "unknown"))]
    for s in schema:
        path, here = f"$.{s.key}", F.array_contains("_names", s.key)
        kind = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
        number = kind.startswith("BIGINT") if s.whole else kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
        value = F.coalesce(F.try_variant_get("_v", path, "double"), F.lit(0.0))
        ranged = value < s.least if s.most == float("inf") else (value < s.least) | (value > s.most)
        wrong = F.when(here & (kind != "VOID") & ~number, found(F.lit(s.key), "wrong type")).when(here & ranged, found(F.lit(s.key), "out of range"))
        parts.append(F.array(F.when(~here, found(F.lit(s.key), "missing")) if s.required else F.lit(None), wrong))
    every = F.filter(F.concat(*parts), lambda x: x.isNotNull())
    none: Column = F.array(found(F.lit(None), "not an object"))
    rows = rows.select(key, F.explode(F.when(F.col("_names").isNull(), none).otherwise(every)).alias("p"))
    return rows.select(key, "p.*")
