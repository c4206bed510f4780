"""Text documents put together from files that include each other.

A file is a list of lines. ``// ...`` is a comment, ``:name: value`` defines an attribute, a line
with ``include::path[]`` stands for another file, whose path counts from the folder of the one that
includes it, and ``{name}`` in any other line stands for the value that the last definition before
it in the whole document gave, or for itself where there is none. Values are not searched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.scratch import free, save, scratch

#: How comments, definitions, includes and references look.
COMMENT = r"^//"
DEFINITION = r"^:([a-zA-Z0-9_-]+):\s*(.*)$"
INCLUDE = r"include::([^\[]+)\[\]"
REFERENCE = r"\{([a-zA-Z0-9_-]+)\}"


def clean_path(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``name/..``; a leading slash stays."""

    def add(parts: Column, part: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        up = (part == "..") & F.coalesce(last != "..", F.lit(False))
        return F.when(part.isin("", "."), parts).when(up, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.concat(parts, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def _lines(files: DataFrame) -> DataFrame:
    """``path, no, line, name, value, target``: the lines of all files that are no comments."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\z", "")
    rows = files.select(clean_path(F.col("path")).alias("path"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line")).filter(~F.col("line").rlike(COMMENT))
    defines, includes = F.col("line").rlike(DEFINITION), F.col("line").rlike(INCLUDE)
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    target = clean_path(F.concat(folder, F.regexp_replace(F.regexp_extract("line", INCLUDE, 1), "^/+", "")))
    return rows.select("path", "no", "line", F.when(defines, F.regexp_extract("line", DEFINITION, 1)).alias("name"), F.when(defines, F.regexp_extract("line", DEFINITION, 2)).alias("value"), F.when(includes & ~defines, target).alias("target"))


def compiled(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``entry, text, error`` for every path of ``entries (entry)``, from ``files (path, text)``.

    Includes are resolved in rounds, one join for each depth, for all entries together. What fails
    first in the document is its error, and its text is null: ``circular include: <path>`` or
    ``no such file: <path>``. A document is one row, so it must fit in a task; its lines need not be
    together before the end. A null text is empty, and an empty file one empty line. Paths tell files
    apart; of two with one path both count.
    """
    facts = ["entry", "place", "line", "name", "value"]
    with scratch() as kept:
        lines = save(_lines(files))
        known = save(lines.select("path").unionByName(files.select(clean_path(F.col("path")).alias("path"))).distinct())
        entries = entries.select("entry").distinct()
        open_ = save(entries.select("entry", F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("through"), clean_path(F.col("entry")).alias("target")))
        done, errors = [], []
        while not open_.isEmpty():
            circular = F.array_contains("through", F.col("target"))
            errors.append(save(open_.filter(circular).select("entry", "place", F.concat(F.lit("circular include: "), "target").alias("error"))))
            going = open_.filter(~circular)
            there = known.withColumnRenamed("path", "target")
            errors.append(save(going.join(there, "target", "left_anti").select("entry", "place", F.concat(F.lit("no such file: "), "target").alias("error"))))
            inner = lines.withColumnRenamed("target", "next").withColumnRenamed("path", "target")
            met = going.join(inner, "target").select("entry", F.concat("place", F.array("no")).alias("place"), F.concat("through", F.array("target")).alias("through"), "line", "name", "value", "next")
            met = save(met)
            done.append(met.filter("next is null").select(*facts))
            free(open_)
            open_ = save(met.filter("next is not null").select("entry", "place", "through", F.col("next").alias("target")))
        rows, failed = _union(done), _union(errors)
        if rows is None:
            kept.append(out := save(entries.select("entry", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))))
            return out
        text = _substituted(rows).groupBy("entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "").alias("text"))
        first = failed.groupBy("entry").agg(F.min_by("error", "place").alias("error"))
        out = entries.join(text, "entry", "left").join(first, "entry", "left")
        out = save(out.select("entry", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error"))
        kept.append(out)
    return out


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def _substituted(rows: DataFrame) -> DataFrame:
    """``entry, place, line`` of all lines that are no definitions, with their references resolved and a line break."""
    said = rows.filter("name is null").select("entry", "place", "line")
    names = F.regexp_extract_all("line", F.lit(REFERENCE), F.lit(1))
    asked = said.filter(F.col("line").rlike(REFERENCE)).select("entry", "place", F.posexplode(names).alias("n", "name"))
    given = rows.filter("name is not null").select("entry", "place", F.lit(-1).alias("n"), "name", F.struct("value").alias("set"))
    both = given.unionByName(asked.withColumn("set", F.lit(None).cast("struct<value:string>")))
    before = Window.partitionBy("entry", "name").orderBy("place", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("now", F.last("set", ignorenulls=True).over(before)).filter("n >= 0")
    value = F.coalesce("now.value", F.concat(F.lit("{"), "name", F.lit("}")))
    found = found.groupBy("entry", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", value.alias("v")))), lambda x: x["v"]).alias("values"))
    gaps = F.split("line", F.lit(REFERENCE), -1)
    pieces = F.transform(F.arrays_zip(gaps.alias("g"), F.col("values").alias("v")), lambda x: F.concat(x["g"], F.coalesce(x["v"], F.lit(""))))
    whole = F.when(F.col("values").isNull(), F.col("line")).otherwise(F.array_join(pieces, ""))
    return said.join(found, ["entry", "place"], "left").select("entry", "place", F.concat(whole, F.lit("\n")).alias("line"))
