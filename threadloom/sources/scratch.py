"""Working tables that end a plan's lineage on storage all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OPEN: ContextVar[list | None] = ContextVar("open_tables", default=None)
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/threadloom-work"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back, which ends its lineage.

    The file sizes also give the optimizer a measured size, so that later joins are
    broadcast only below ``spark.sql.autoBroadcastJoinThreshold``. Shuffle files of the write go
    when it ends; the table itself goes with ``free`` or at the end of the ``scratch`` around it.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_dir(spark)
    before = spark.conf.get(_SHUFFLES_GO, "false")
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLES_GO, before)
    out = spark.read.schema(schema).parquet(path)
    out._saved_at = path
    if (tables := _OPEN.get()) is not None:
        tables.append(out)
    return out


def save_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Write several DataFrames of the same columns one after the other and read them as one table.

    Each is a job and a plan of its own, so their number can grow where a union's can't.
    """
    path = out = None
    for k, part in enumerate(parts):
        spark, schema = part.sparkSession, part.schema
        path = path or shared_dir(spark)
        part.write.parquet(f"{path}/part{k}")
        out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    out._saved_at = path
    if (tables := _OPEN.get()) is not None:
        tables.append(out)
    return out


def free(*tables: DataFrame) -> None:
    """Delete what ``save`` wrote for these tables; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_saved_at", None)
        if path:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A fresh shared folder that goes at the end."""
    folder = shared_dir(spark)
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list]:
    """Delete the tables saved inside, other than those put into the yielded list, at its end."""
    made: list = []
    kept: list = []
    outer = _OPEN.get()
    token = _OPEN.set(made)
    try:
        yield kept
    finally:
        _OPEN.reset(token)
        paths = {t._saved_at for t in kept}
        free(*[t for t in made if t._saved_at not in paths])
        if outer is not None:
            outer.extend(kept)
