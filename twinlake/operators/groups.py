"""Groups of equal files in long form, one row a file: ``match_type, match_key, hash, duplicate_count, path,
size_bytes``, and what is reported of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.functions import digests
from twinlake.functions.paths import base_name
from twinlake.functions.sizes import display_size
from twinlake.operators.keyfilter import marked_rows

#: The columns of exported reports.
LONG = ["match_type", "match_key", "hash", "duplicate_count", "path", "size_bytes"]
#: Salts of a group whose first rows are wanted.
SALTS = 64


def having(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Rows of groups with ``least`` members or more, with ``duplicate_count``. Counts are combined before
    they are shuffled and the join back can be split, so the size of a group does not matter."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("duplicate_count")).where(F.col("duplicate_count") >= least)
    return rows.join(counts, keys)


def digest_of(content: Column, algorithm: str = "sha256") -> Column:
    if digests.parse_algorithm(algorithm) == "blake3":
        from twinlake.functions.blake3 import blake3_hex

        return blake3_hex(content.cast("binary"))
    return digests.full_digest(content)


def hashed(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``(path, size_bytes, hash)``, written once to the shared folder: whatever is then asked of the groups, content
    is read and hashed once and only this narrow relation is shuffled."""
    return cut(files.select("path", F.col("size").alias("size_bytes"), digest_of(F.col("content"), algorithm).alias("hash")))


def groups_of(rows: DataFrame, least: int = 2) -> DataFrame:
    """Content groups of a relation of hashed files."""
    found = having(rows, ["hash"], least)
    return found.select(F.lit("content").alias("match_type"), F.col("hash").alias("match_key"), "hash", "duplicate_count", "path", "size_bytes")


def content_groups(files: DataFrame, least: int = 2, algorithm: str = "sha256") -> DataFrame:
    """Files with equal content, in one pass over it."""
    return groups_of(hashed(files, algorithm), least)


@dataclass
class Staged:
    """A staged run: its groups, one row of counters that come out of the same stages, and all files whose digests it
    holds (``path, size_bytes, hash``), those in smaller groups than are shown too."""

    groups: DataFrame
    metrics: DataFrame
    held: DataFrame

    def reducible(self) -> DataFrame:
        """The groups that a plan may reduce if it is not to respect the least size of a shown group: two files or
        more of one digest, though fewer than that size, where a size and sample had as many as that."""
        return groups_of(self.held, 2)

    def counts(self) -> DataFrame:
        """One row: groups that are shown, and digests that are held, single files too."""
        both = self.groups.select(F.col("hash").alias("shown"), F.lit(None).cast("string").alias("all")).unionByName(self.held.select(F.lit(None).cast("string").alias("shown"), F.col("hash").alias("all")))
        return both.agg(F.countDistinct("shown").alias("shown_groups"), F.countDistinct("all").alias("held_groups"))


Reader = Callable[[DataFrame], DataFrame]


def staged(files: DataFrame, sample: Reader, full: Reader, least: int = 2) -> Staged:
    """Files with equal content by size, then by a sample, then in full: content that a cheaper test sets apart is not
    read whole. ``sample`` and ``full`` add a column of that name resp. ``hash`` to rows of ``files``; a null digest is
    that of a file that cannot be read. Content never leaves the task that reads it; sizes, samples and digests do.

    Counters are files scanned, sampled, hashed in full, and skipped by size and by sample: sums of the counts that
    the stages group by, so nothing is scanned or read again for them."""
    counts = cut(files.groupBy("size").agg(F.count("*").alias("n")))
    sizes = counts.where(F.col("n") >= least).select("size")
    sampled = cut(sample(marked_rows(files, sizes, ["size"])).select("path", "size", "sample").where("sample is not null"))
    pairs = cut(sampled.groupBy("size", "sample").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    over = ~digests.covers_whole_file(F.col("size"))
    small = sampled.where(~over).join(pairs.where(~over).select("size", "sample"), ["size", "sample"], "left_semi").select("path", F.col("size").alias("size_bytes"), F.col("sample").alias("hash"))
    wanted = sampled.where(over).join(pairs.where(over).select("size", "sample"), ["size", "sample"], "left_semi").select("path", "size")
    large = marked_rows(files.where(over), wanted, ["path", "size"])
    read = full(large).select("path", F.col("size").alias("size_bytes"), "hash").where("hash is not null")
    # the filter lets some other files pass, which agree with too few to be held
    asked = wanted.select(F.col("path").alias("asked_path"), F.col("size").alias("asked_size"))
    whole = cut(read.join(asked, F.col("path").eqNullSafe(F.col("asked_path")) & (F.col("size_bytes") == F.col("asked_size")), "left_semi"))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    many = F.col("n") >= least
    by_size = counts.agg(F.sum("n").alias("scanned"), F.sum(F.when(many, F.col("n"))).alias("sampled"), F.sum(F.when(~many, F.col("n"))).alias("skipped_by_size"))
    by_sample = pairs.agg(F.sum(F.when(over, F.col("n"))).alias("fully_hashed"), (-F.sum("n")).alias("skipped_by_sample"))
    both = by_size.withColumn("skipped_by_sample", F.col("sampled")).unionByName(by_sample, allowMissingColumns=True)
    metrics = both.agg(*(zero(c).alias(c) for c in ("scanned", "sampled", "fully_hashed", "skipped_by_size", "skipped_by_sample")))
    rows = small.unionByName(whole)
    return Staged(groups_of(rows, least), metrics, rows)


def column_readers(algorithm: str = "sha256") -> tuple[Reader, Reader]:
    """``sample`` and ``full`` of relations with a ``content`` column."""
    sample = digests.sample_digest(F.col("content")) if digests.parse_algorithm(algorithm) == "sha256" else digest_of(F.substring(F.col("content").cast("binary"), 1, digests.SAMPLE_BYTES), algorithm)
    return lambda rows: rows.withColumn("sample", sample), lambda rows: rows.withColumn("hash", digest_of(F.col("content"), algorithm))


def tree_readers(algorithm: str = "sha256") -> tuple[Reader, Reader]:
    """``sample`` and ``full`` of scans of directories, whose files the tasks read in pieces. A small file's sample is
    all of it, so it is made by the algorithm of the groups."""
    from twinlake.sources.content import with_facts

    short = digests.covers_whole_file(F.col("size"))

    def sample(rows: DataFrame) -> DataFrame:
        if digests.parse_algorithm(algorithm) == "sha256":
            return with_facts(rows, ("sample",))
        return with_facts(rows.where(~short), ("sample",)).unionByName(with_facts(rows.where(short), ("hash",), algorithm).withColumnRenamed("hash", "sample"))

    return sample, lambda rows: with_facts(rows, ("hash",), algorithm)


def staged_content(files: DataFrame, least: int = 2, algorithm: str = "sha256") -> Staged:
    """``staged`` over a relation with a ``content`` column."""
    return staged(files, *column_readers(algorithm), least)


def staged_groups(files: DataFrame, least: int = 2) -> DataFrame:
    return staged_content(files, least).groups


def staged_tree(files: DataFrame, least: int = 2, algorithm: str = "sha256") -> Staged:
    """``staged`` over a scan of directories: files are read by the tasks in pieces, the first 4 KiB of those that share
    a size, and all of those that share these too. Files that cannot be read are in no group."""
    return staged(files.select([c for c in ("path", "root", "size") if c in files.columns]), *tree_readers(algorithm), least)


def same_content(files: DataFrame, target: DataFrame, sample: Reader, full: Reader) -> DataFrame:
    """The group, in long form, of the one file of ``target``, which need not be among ``files``: files of its size are
    sampled, and those of its sample are read whole. Without another file of its content there is no group."""
    one = full(sample(target)).select("path", F.col("size").alias("size_bytes"), "sample", "hash").first()
    if one is None or one["hash"] is None:
        return groups_of(files.select("path", F.col("size").alias("size_bytes"), F.lit("").alias("hash")).limit(0))
    rows = files.where((F.col("size") == one["size_bytes"]) & (F.col("path") != one["path"]))
    rows = full(sample(rows).where(F.col("sample") == one["sample"])).where(F.col("hash") == one["hash"]).select("path", F.col("size").alias("size_bytes"), "hash")
    own = files.sparkSession.createDataFrame([(one["path"], one["size_bytes"], one["hash"])], "path string, size_bytes long, hash string")
    return groups_of(cut(rows.unionByName(own)))


def stage_metrics(files: DataFrame, least: int = 2) -> DataFrame:
    """The counters of a staged run over a relation with a ``content`` column."""
    return staged_content(files, least).metrics


def name_groups(files: DataFrame, least: int = 2, name: str | None = None) -> DataFrame:
    """Files with one base name (of that name only, if given); content is not read."""
    rows = files.select("path", F.col("size").alias("size_bytes"), base_name(F.col("path")).alias("match_key"))
    if name is not None:
        bare = name.rstrip("/").rsplit("/", 1)[-1]
        if bare in ("", "."):
            raise ValueError("a folder has no file name")
        rows = rows.where(F.col("match_key") == bare)
    found = having(rows, ["match_key"], least)
    return found.select(F.lit("name").alias("match_type"), "match_key", digests.synthetic_digest("name", F.col("match_key")).alias("hash"), "duplicate_count", "path", "size_bytes")


def name_metrics(files: DataFrame, name: str | None = None) -> DataFrame:
    """One row: files scanned, and those that another name than the one looked for left out."""
    other = F.lit(False) if name is None else base_name(F.col("path")) != F.lit(name.rstrip("/").rsplit("/", 1)[-1])
    return files.agg(F.count("*").alias("scanned"), F.count_if(other).alias("skipped_by_name"))


def same_as(files: DataFrame, path: str, target: DataFrame | None = None) -> DataFrame:
    """Files with the content of the one at ``path``, that one first: ``path, size, is_target``. ``target`` is a
    relation that holds the file where ``files`` does not (it lies outside the roots). The target's size, sample
    and digest are one row; a file's sample is taken where the size agrees, and its digest where both do."""
    full, sample = digests.full_digest(F.col("content")), digests.sample_digest(F.col("content"))
    own = (files if target is None else target).where(F.col("path") == path).select("path", "size", "content")
    first = own.select("path", "size", sample.alias("sample"), full.alias("full")).first()
    if first is None:
        return files.select("path", "size", F.lit(False).alias("is_target")).limit(0)
    agrees = F.when(F.col("size") == first["size"], F.when(sample == first["sample"], full == first["full"]))
    found = files.where((F.col("size") == first["size"]) & F.coalesce(agrees, F.lit(False))).select("path", "size", (F.col("path") == path).alias("is_target"))
    if target is not None:
        found = found.where(~F.col("is_target")).unionByName(own.select("path", "size", F.lit(True).alias("is_target")))
    return found.orderBy(F.desc("is_target"), "path")


def title_of(summary: DataFrame, compact: bool = False) -> Column:
    """What a group is called: the start of its digest, or its name or key, with its files and their total."""
    # fixed values: the formats of titles
    named = F.when(F.col("match_type") == "name", "Name: ").otherwise("Similar: ")
    label = F.when(F.col("match_type") == "content", F.substring("hash", 1, 16 if compact else 32)).otherwise(F.concat(named, F.col("match_key")))
    shown, count = display_size(F.col("total_bytes")), F.col("duplicate_count").cast("string")
    if compact:
        return F.concat(label, F.lit(" - "), count, F.lit(" files - approx. "), shown)
    whole = F.concat(label, F.lit(" - "), count, F.lit(" files - (approx. size "), shown, F.lit(")"))
    return F.when(F.col("duplicate_count") == 0, "Empty group").otherwise(whole)


def group_summary(groups: DataFrame) -> DataFrame:
    """A row per group: count, total and reclaimable bytes, first path, title."""
    out = groups.groupBy("match_type", "match_key", "hash").agg(
        F.count("*").alias("duplicate_count"), F.sum("size_bytes").alias("total_bytes"), (F.sum("size_bytes") - F.max("size_bytes")).alias("reclaimable_bytes"), F.min("path").alias("first_path")
    )
    return out.withColumns({"title": title_of(out), "compact_title": title_of(out, compact=True)})


SORT_MODES = ["size", "count"]


def next_mode(by: str) -> str:
    """The sort mode after ``by``; of an unknown one, the first."""
    return SORT_MODES[(SORT_MODES.index(by) + 1) % len(SORT_MODES)] if by in SORT_MODES else SORT_MODES[0]


def sorted_groups(summary: DataFrame, by: str = "size") -> DataFrame:
    """Largest total first, or most files first; digests settle ties. An unknown mode is that of sizes."""
    keys = ["duplicate_count", "total_bytes"] if by == "count" else ["total_bytes", "duplicate_count"]
    return summary.orderBy(*(F.desc(k) for k in keys), "hash")


def overall(groups: DataFrame) -> DataFrame:
    """One row: number of groups, files in them, bytes in them."""
    counts = groups.groupBy("hash").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return counts.agg(F.count("*").alias("group_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"))


def average_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_size"), F.count("*").alias("files"))


def first_rows(groups: DataFrame, n: int, target: str | None = None) -> DataFrame:
    """``(hash, path, ordinal)`` of the first ``n`` paths of each group, a ``target`` before all others: first of
    every salt, then of all, so no task sorts a whole large group."""
    order = [F.col("path") != F.lit(target), F.col("path")] if target is not None else [F.col("path")]
    salted = groups.select("hash", "path", F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("salt"))
    some = salted.withColumn("ordinal", F.row_number().over(Window.partitionBy("hash", "salt").orderBy(*order))).where(F.col("ordinal") <= n)
    return some.withColumn("ordinal", F.row_number().over(Window.partitionBy("hash").orderBy(*order))).where(F.col("ordinal") <= n).select("hash", "path", "ordinal")


def keep_plan(groups: DataFrame, keep: int = 1, action: str = "delete", target: str | None = None) -> DataFrame:
    """``(hash, path, action, target)``: the first ``keep`` paths stay, a ``target`` first of all, the rest are
    deleted, or replaced by a link or clone of the first. Nothing is done to any file here."""
    if keep < 1:
        raise ValueError("one file at least is kept")
    if action not in ("delete", "link", "reflink"):
        raise ValueError(f"unknown action: {action!r}")
    place = F.struct((F.col("path") != F.lit(target) if target is not None else F.lit(False)).alias("later"), "path")
    kept = first_rows(groups, keep, target).groupBy("hash").agg(F.min(place).alias("top"), F.max(place).alias("last"))
    rest = place > F.col("last")
    return groups.join(kept, "hash").select(
        "hash", "path", F.when(rest, action).otherwise("keep").alias("action"), F.when(rest & F.lit(action != "delete"), F.col("top.path")).alias("target")
    )


def auto_mark(groups: DataFrame) -> DataFrame:
    """``marked``: all but the first file of each group; none in near-content groups."""
    first = groups.groupBy("hash").agg(F.min("path").alias("first_path"))
    return groups.join(first, "hash").select(*LONG, ((F.col("path") != F.col("first_path")) & (F.col("match_type") != "fuzzy")).alias("marked"))


def mark_all(marked: DataFrame, on: bool = True) -> DataFrame:
    """Every file marked, but for those that are ``deleted`` where the relation tells, or none."""
    gone = F.coalesce(F.col("status") == "deleted", F.lit(False)) if "status" in marked.columns else F.lit(False)
    return marked.withColumn("marked", F.lit(on) & ~gone)


def toggled(marked: DataFrame, path: str) -> DataFrame:
    """The mark of one file turned over, in groups of any kind."""
    return marked.withColumn("marked", F.col("marked") != (F.col("path") == path))


def marked_files(marked: DataFrame) -> DataFrame:
    return marked.where("marked").select("hash", "path", "size_bytes").orderBy("hash", "path")


def marked_count(marked: DataFrame) -> DataFrame:
    """One row: marked files and their bytes."""
    return marked.agg(F.count_if("marked").alias("marked"), F.coalesce(F.sum(F.when(F.col("marked"), F.col("size_bytes"))), F.lit(0)).alias("marked_bytes"))


def review(groups: DataFrame, by: str = "size") -> DataFrame:
    """What a reviewer sees, a row a file: titles, totals and marks, groups in order."""
    summary = group_summary(groups).select("hash", "match_type", "total_bytes", "title")
    keys = ["duplicate_count", "total_bytes"] if by == "count" else ["total_bytes", "duplicate_count"]
    return auto_mark(groups).join(summary, ["hash", "match_type"]).select(*LONG, "total_bytes", "title", "marked").orderBy(*(F.desc(k) for k in keys), "hash", "path")


def survivors(marked: DataFrame) -> DataFrame:
    """``(hash, target)`` of groups with marked files: the first path that is neither marked nor deleted, or null."""
    gone = F.coalesce(F.col("status") == "deleted", F.lit(False)) if "status" in marked.columns else F.lit(False)
    left = F.when(~F.col("marked") & ~gone, F.col("path"))
    return marked.groupBy("hash").agg(F.min(left).alias("target"), F.max("marked").alias("any")).where("any").select("hash", "target")


def mark_plan(marked: DataFrame, action: str = "delete") -> DataFrame:
    """``(hash, path, action, target, error)`` for marked files: the target is the group's first unmarked file;
    links and clones without one are errors."""
    out = marked.where("marked").join(survivors(marked), "hash")
    error = F.when(F.col("target").isNull() & F.lit(action != "delete"), F.lit("no unmarked file is left in the group"))
    return out.select("hash", "path", F.lit(action).alias("action"), "target", error.alias("error"))


def numbered(distinct: DataFrame, column: str, name: str) -> DataFrame:
    """``distinct`` with 1-based ranks of ``column``: sorted by ranges, numbered within each, and moved by the
    counts of the ranges before (as many rows as there are partitions)."""
    ranged = cut(distinct.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r.part, before))
        before += r.n
    parts = distinct.sparkSession.createDataFrame(offsets, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return ranged.withColumn("within", within).join(F.broadcast(parts), "part").withColumn(name, (F.col("within") + F.col("before")).cast("long")).drop("part", "within", "before")
