"""Arrays and matrices from the tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.depths import saturate
from ..operators import arrays


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(e: Column) -> Column:
    """An embedding's elements as 8U."""
    return F.transform(e, lambda v: saturate((v.cast("double") + 1) * 127.5, "8U"))


def clipped_bytes_of(e: Column) -> Column:
    """A second quantisation, which clips often."""
    return F.transform(e, lambda v: saturate(v.cast("double") * 600 + 128, "8U"))


def images(spark: SparkSession, sf_dir: str, h: int = 8, w: int = 8, cn: int = 1, second: bool = False) -> DataFrame:
    """Dense 8U arrays of 64 elements."""
    make = clipped_bytes_of if second else bytes_of
    return arrays.dense(table(spark, sf_dir, "embeddings"), "vec_id", make(F.col("embedding")), h, w, cn)


def pixels(spark: SparkSession, sf_dir: str, h: int = 8, w: int = 8, cn: int = 1, second: bool = False) -> DataFrame:
    return arrays.pixels(images(spark, sf_dir, h, w, cn, second))


def colour(spark: SparkSession, sf_dir: str, channels: int = 3) -> DataFrame:
    """Dense 4x4 images of up to four channels."""
    kept = F.filter("data", lambda v, i: i % 4 < channels)
    return images(spark, sf_dir, 4, 4, 4).withColumns({"data": kept, "cn": F.lit(channels)})


def operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img_id, i`` and two values in a row: bytes ``a`` and ``b``, floats ``f`` and ``g``."""
    e = table(spark, sf_dir, "embeddings")
    each = e.select(F.col("vec_id").alias("img_id"), F.posexplode(F.arrays_zip(bytes_of(F.col("embedding")).alias("a"), clipped_bytes_of(F.col("embedding")).alias("b"), F.col("embedding").alias("f"), F.reverse("embedding").alias("g"))).alias("i", "s"))
    return each.select("img_id", "i", "s.a", "s.b", "s.f", "s.g")


def matrices(spark: SparkSession, sf_dir: str, reverse: bool = False) -> DataFrame:
    """8x8 matrices ``mat_id, i, j, v`` of the embeddings, forwards or backwards."""
    e = table(spark, sf_dir, "embeddings")
    data = F.reverse("embedding") if reverse else F.col("embedding")
    each = e.select(F.col("vec_id").alias("mat_id"), F.posexplode(data).alias("k", "v"))
    return each.select("mat_id", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).cast("int").alias("j"), "v")
