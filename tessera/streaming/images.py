"""Streams of image files through row-wise operators.

Files that arrive in a folder become elements; thresholds and tables need no state, and
counts by image are kept under a watermark on the files' times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays
from ..sources.images import _elements, parse_pnm


def read_pnm_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Dense arrays of PGM and PPM files as they arrive; ``img_id`` is a hash of the path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return _elements(files.select("path", "content"), parse_pnm).select(F.xxhash64("path").alias("img_id"), "h", "w", "cn", "data")


def pixel_stream(stream: DataFrame) -> DataFrame:
    """Elements of a stream of dense arrays; no shuffle."""
    return arrays.pixels(stream, colocate=False)


def level_counts(stream: DataFrame) -> DataFrame:
    """Running counts of values by image: a streaming aggregate, to be written in complete or update mode."""
    return pixel_stream(stream).groupBy("img_id", "v").agg(F.count(F.lit(1)).alias("n"))
