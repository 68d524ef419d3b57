"""Tables as relations of files: ``path``, ``size`` in bytes, ``content``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_files(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """Null content is empty; rows with a null path are dropped, as a file has a path."""
    filled = F.coalesce(content, F.lit(""))
    return df.select(path.alias("path"), F.octet_length(filled).cast("long").alias("size"), filled.alias("content")).where("path is not null")


def documents(df: DataFrame) -> DataFrame:
    return as_files(df, F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))


def pages(df: DataFrame) -> DataFrame:
    return as_files(df, F.col("url"), F.col("html"))


def conversations(df: DataFrame) -> DataFrame:
    return as_files(df, F.concat(F.lit("/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")), F.col("text"))
