"""Exact duplicates by a tree of merges of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.operators.keyfilter import without

#: The characters that do not count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Each round merges 2^ROUNDS runs, that is, as many binomial rounds at once.
ROUNDS = 3
KEY = ["digest", "n_bytes", "check"]


def first_runs(rows: DataFrame, best: Column) -> DataFrame:
    """A sorted run a partition of ``rows``: each digest once, with its best row and the number of rows."""
    own = rows.select(F.spark_partition_id().alias("run"), part_of(F.col("digest")).alias("range"), *KEY, best.alias("best"), F.lit(1).cast("long").alias("group_size"))
    return _merged(own.sortWithinPartitions("run", "range", *KEY))


def part_of(digest: Column) -> Column:
    """The range of digests that a digest lies in."""
    return F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int")


def merge(runs: DataFrame, shift: int) -> DataFrame:
    """Merge runs whose numbers agree but for the last ``shift`` bits. Each run is cut into ranges of digests; what the
    runs have of a range comes together in order, and neighbours that are equal (digest, length and a second hash)
    become one, with the best row and the number of rows. A task holds ranges of a merge, never a whole run."""
    moved = runs.withColumn("run", F.shiftright("run", shift)).repartition("run", "range")
    return _merged(moved.sortWithinPartitions("run", "range", *KEY))


def _merged(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy("run", "range", *KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when identical without blanks; null counts as empty, and empty texts are one group.
    Of a group, the row with the most code points in its original text stays, then the smallest id; a
    null id comes last. Rows that repeat the staying id are all kept, as the id is all that tells rows
    apart. Other columns are not read; an empty table gives an empty result.

    Every partition sorts its digests into a run, each once with its best row and count. Rounds then merge 8 runs into
    one, range of digests by range, until one run is left. A digest has at most one entry per run, so a group of copies
    of any size is a handful of rows in any task; only the final join meets all rows of a group, and that join can be
    split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), bare.alias("bare")).select(
            "doc_id", F.unhex(F.sha2("bare", 256)).alias("digest"), F.octet_length("bare").alias("n_bytes"), F.xxhash64("bare").alias("check"), F.char_length("text").alias("n_chars")
        )
    )
    best = F.struct((-F.col("n_chars")).alias("order"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"))
    runs = first_runs(rows, best)
    count = 1 + (rows.select(F.spark_partition_id().alias("run")).agg(F.max("run")).first()[0] or 0)
    while count > 1:
        runs = merge(runs, ROUNDS)
        count = (count + (1 << ROUNDS) - 1) >> ROUNDS
    winners = runs.select(*KEY, F.col("best.keep_id").alias("keep_id"), "group_size")
    return rows.join(winners, KEY).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that share an id, null too, those go
    whose texts go."""
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept"))
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), BLANKS, ""), 256)
    return without(docs, gone, {"doc_id": F.col(id_col), "text_sha256": digest})


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM w
"""
