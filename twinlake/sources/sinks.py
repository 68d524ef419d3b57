"""Reports of groups, and manifests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.operators.groups import LONG
from twinlake.operators.manifests import SCHEMA, merge_manifests
from twinlake.sources import versions
from twinlake.sources.document import ORDER, bullet_row, csv_row, json_row, numbered_row, rendered, write_document
from twinlake.sources.lines import numbered_lines


def write_csv(groups: DataFrame, path: str) -> None:
    write_document(groups, path, csv_row, lambda n: ",".join(LONG) + "\n", lambda n: "")


def write_json(groups: DataFrame, path: str) -> None:
    """``{group_count, groups: [{match_type, match_key, hash, duplicate_count, files: [{path, size}]}]}``,
    indented by two, with ``<>&`` escaped and no line end at the end."""
    head = lambda n: f'{{\n  "group_count": {n},\n  "groups": ['
    write_document(groups, path, json_row, head, lambda n: "\n      ]\n    }\n  ]\n}" if n else "]\n}")


def write_text(groups: DataFrame, path: str, bullets: bool = False) -> None:
    """A header a group, then its numbered paths or bullets."""
    write_document(groups, path, bullet_row if bullets else numbered_row, lambda n: "", lambda n: "")


def text_lines(groups: DataFrame, bullets: bool = False) -> Iterator[str]:
    """The lines of ``write_text`` one after the other, for a terminal: they pass through the driver, a partition at a time."""
    rows = (tuple(r) for r in groups.select(LONG).orderBy(*ORDER).toLocalIterator())
    for text in rendered(rows, bullet_row if bullets else numbered_row):
        yield from text.splitlines()


def write_csv_parts(groups: DataFrame, folder: str) -> None:
    """The report as a folder of CSV files in order, a task a file: nothing goes through the driver."""
    groups.select(LONG).orderBy(*ORDER).write.mode("errorifexists").option("header", True).csv(folder)


def elapsed_line(seconds: float) -> str:
    return f"done after {seconds:.2f} s"


def summary_line(metrics: dict[str, int], seconds: float, mode: str = "content") -> str:
    """What a run of a mode (content, single, fuzzy, name) did, from its one row of metrics: each counter by its name."""
    told = ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in metrics.items())
    return f"{mode} run, {told}; {elapsed_line(seconds)}"


#: The longest line of a manifest, in bytes.
LINE = 4 << 20


def append_manifest(entries: DataFrame, folder: str) -> int:
    """Add entries to a manifest, which may not exist yet, as a version of it (``versions.append``): those of files that it
    does not have, one a file. Returns the version's number, or 0 where nothing is new. What is there is not written again."""
    spark = entries.sparkSession

    def new_rows(folders: list[str]) -> DataFrame:
        rows = merge_manifests(entries.limit(0), entries)
        if folders:
            rows = rows.join(_entries(spark, folders).select("restore_path"), "restore_path", "left_anti")
        return rows.select(entries.columns).orderBy("group_id", "restore_path")

    return versions.append(spark, folder, new_rows)


def write_manifest(entries: DataFrame, folder: str) -> None:
    """JSON lines; Spark's commit makes the folder appear whole or not at all."""
    entries.orderBy("group_id", "restore_path").write.mode("errorifexists").json(folder)


def _entries(spark: SparkSession, paths: list[str], longest: int | None = None) -> DataFrame:
    most = LINE if longest is None else longest
    names = SCHEMA + ", _bad string"
    lines = numbered_lines(spark, paths).where("trim(value) <> ''").withColumn("entry", F.from_json("value", names, {"columnNameOfCorruptRecord": "_bad"}))
    wrong = (
        F.when(F.octet_length("value") > most, f"is longer than {most} bytes")
        .when(~F.ltrim("value").startswith("{"), "is not an object")
        .when(F.col("entry._bad").isNotNull() | F.col("entry").isNull(), "is not an entry")
    )
    error = F.concat(F.lit("line "), "line", F.lit(" "), wrong, F.lit(": "), "file")
    # In the filter for readers of no column, in the column for filters of readers that are moved before it.
    right = F.when(wrong.isNull(), True).otherwise(F.raise_error(error).cast("boolean"))
    checked = F.when(wrong.isNull(), F.col("entry")).otherwise(F.raise_error(error))
    return lines.where(right).select(checked.alias("entry")).select("entry.*").drop("_bad")


def read_manifest(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """The entries of a manifest: a file, or a folder with its versions. Blank lines are passed over; a line that is no JSON
    object of an entry's types, or longer than ``longest`` bytes (``LINE``), is an error that tells its number and file,
    whatever is read of the result. Fields that an entry lacks are null; others are left out."""
    folders = versions.committed(spark, path).folders
    return _entries(spark, folders, longest) if folders else spark.createDataFrame([], SCHEMA)
