"""Lines of text files with their numbers, however many tasks read a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlake.session import bound_batches


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``line`` counts from 1 in each split; a task reads its splits one after the other, each in its order."""
    split, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, begin = batch.column("file"), batch.column("begin")
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(begin[1:], begin[:-1]))
        heads = np.concatenate([[0], np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1])
        if (file[0].as_py(), begin[0].as_py()) != split:
            n = 0
        line = np.arange(1, batch.num_rows + 1) - np.repeat(heads, np.diff(np.append(heads, batch.num_rows)))
        line[: heads[1] if len(heads) > 1 else None] += n
        split, n = (file[-1].as_py(), begin[-1].as_py()), int(line[-1])
        yield pa.RecordBatch.from_arrays([file, begin, pa.array(line), batch.column("value")], names=["file", "begin", "line", "value"])


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line (from 1), value`` of text files in any store that Spark reads. The lines of each split of a file are
    counted in a first pass; sums of these counts, a row a split, tell where the second begins to count. A task
    holds one line whole. Empty files have no lines; what follows the last line end is a line unless it is empty."""
    bound_batches(spark)
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")
    counts = lines.groupBy("file", "begin").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("file", "begin", F.coalesce(earlier, F.lit(0)).alias("before"))
    numbered = lines.mapInArrow(_number, "file string, begin long, line long, value string")
    return numbered.join(before, ["file", "begin"]).select("file", (F.col("line") + F.col("before")).alias("line"), "value")
