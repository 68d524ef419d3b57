"""Exact duplicates of a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions.digests import full_digest


def first_arrivals(files: DataFrame, time_col: str, delay: str) -> DataFrame:
    """The first file of each content within ``delay``: digests are state, dropped when the watermark passes."""
    return files.withColumn("hash", full_digest(F.col("content"))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["hash"])
