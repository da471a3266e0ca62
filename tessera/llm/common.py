"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\f\r"
#: Rows of a few numbers in a partition of a gathered table, and numbers where rows hold lists of them.
ROWS_A_TASK = 100_000
NUMBERS_A_TASK = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under *sf_dir*."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is missing and tasks run in the driver's process (local tests) a
    temporary folder is set; on a cluster a missing setting is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not at:
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessera-shared-")
    if not known.isDefined():
        context.setCheckpointDir(at)
    return at


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """*df* with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, numbers: Column | None = None) -> DataFrame:
    """*df*, one or more cut tables of a few numbers a row, or of *numbers*, in no more partitions than it needs by a count.

    Joins and groups of tables of one partition need no shuffle; large tables keep their partitions.
    """
    few = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)  # many small partitions are counted by few tasks
    if numbers is None:
        return df.coalesce(max(1, -(-few.count() // ROWS_A_TASK)))
    total = few.agg(F.coalesce(F.sum(numbers.cast("long")), F.lit(0))).first()[0]
    return df.coalesce(max(1, -(-total // NUMBERS_A_TASK)))


def dealt(df: DataFrame) -> DataFrame:
    """A cut table dealt out evenly to as many partitions as shuffles have, for a join of few rows that makes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, name: str) -> DataFrame:
    """*df* written as Parquet to the shared folder and read again."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows made on the driver as a table, by parsing them in the plan; no Python runs on the executors for it."""
    names = [c.split()[0] for c in schema.split(", ")]
    body = json.dumps([dict(zip(names, map(_plain, r), strict=True)) for r in rows])
    texts = ", ".join(f"{n} string" for n in names)
    each = spark.range(1).select(F.explode(F.from_json(F.lit(body), f"array<struct<{texts.replace(' string', ': string')}>>")).alias("r"))
    return each.select(*[F.col(f"r.{n}").cast(c.split(" ", 1)[1]).alias(n) for n, c in zip(names, schema.split(", "), strict=True)])


def _plain(value) -> str | None:
    return None if value is None else str(value)


def text_of(df: DataFrame, column: str = "text"):
    """The text column, a null counting as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def _at(spark: SparkSession, path: str):
    """The Hadoop file system of *path*, and the path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any file system that Spark reaches."""
    system, place = _at(spark, path)
    return system.exists(place)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    system, place = _at(spark, path)
    system.delete(place, True)


def give_back() -> None:
    """Returns freed memory to the system; Python workers live on between tasks and stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """*run* over a task's batches, after which its memory goes back."""

    def then(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return then
