"""Row filters over a relation of files; all are plain predicates that Catalyst pushes down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.functions.paths import is_at_or_below, parts_below
from twinlake.operators.keyfilter import marked_rows, without
from twinlake.plans.config import VIRTUAL, ScanConfig

#: Excluded folders that are terms of a predicate; more are a relation.
TERMS = 32


def size_filter(size: Column, config: ScanConfig) -> Column:
    """Bounds are inclusive; empty files only if asked for."""
    ok = F.lit(True) if config.empty else size > 0
    if config.min_size:
        ok = ok & (size >= config.min_size)
    if config.max_size:
        ok = ok & (size <= config.max_size)
    return ok


def visible(path: Column, root: Column) -> Column:
    """No component below the root begins with a dot."""
    return ~F.exists(parts_below(path, root), lambda p: p.startswith("."))


def within_depth(path: Column, root: Column, most: int) -> Column:
    """Files directly in the root have depth 0; -1 is any depth."""
    return F.lit(True) if most < 0 else F.size(parts_below(path, root)) - 1 <= most


def not_excluded(path: Column, folders: list[str]) -> Column:
    ok = F.lit(True)
    for folder in dict.fromkeys(folders):
        ok = ok & ~is_at_or_below(path, folder)
    return ok


def exclude_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """The files that lie neither at nor below one of ``folders`` (column ``path``), of which there may be any number.

    A file gives out those of its folders that are as deep as some excluded one; a filter of keys passes few that are
    not excluded, a join by the path decides, and files leave their tasks only if they may be below one."""
    bare = lambda c: F.when(F.rtrim(c, F.lit("/")) == "", "/").otherwise(F.rtrim(c, F.lit("/")))
    gone = cut(folders.where("path <> ''").select(bare(F.col("path")).alias("folder")).distinct())
    depth = F.when(F.col("folder") == "/", 0).otherwise(F.size(F.split("folder", "/")) - 1)
    depths = sorted(r[0] for r in gone.select(depth).distinct().collect())
    if not depths:
        return files
    parts = F.split("path", "/")
    above = [F.when(F.size(parts) > n, F.concat(F.lit("/") if n == 0 else F.lit(""), F.array_join(F.slice(parts, 1, n + 1), "/")) if n else F.lit("/")) for n in depths]
    own = files.select("path", F.explode(F.array_compact(F.array(*above))).alias("folder"))
    below = marked_rows(own, gone, ["folder"]).join(gone, "folder", "left_semi").select("path")
    return without(files, below, {"path": F.col("path")})


def same_device(dev: Column, root_dev: Column) -> Column:
    """Unknown devices count as the same."""
    return F.coalesce(dev == root_dev, F.lit(True))


def first_links(files: DataFrame) -> DataFrame:
    """Of paths with one ``(dev, ino)`` the smallest, once, even if overlapping roots found it twice; files without
    an identity all stay. An aggregation with map-side combine, so a much-linked file is no skew."""
    identified = files.where("dev is not null and ino is not null")
    first = identified.groupBy("dev", "ino").agg(F.min("path").alias("path"))
    return identified.join(first, ["dev", "ino", "path"], "left_semi").dropDuplicates(["dev", "ino", "path"]).select(files.columns).unionByName(files.where("dev is null or ino is null"))


def apply_filters(files: DataFrame, config: ScanConfig, root: str = "/") -> DataFrame:
    """All filters in order; the links' claim comes last, where the relation has ``dev`` and ``ino``."""
    path, top = F.col("path"), F.col("root") if "root" in files.columns else F.lit(root)
    ok = size_filter(F.col("size"), config) & within_depth(path, top, config.max_depth)
    few = len(config.exclude) <= TERMS
    ok = ok & not_excluded(path, (config.exclude if few else []) + ([] if config.virtual else VIRTUAL))
    if not config.hidden:
        ok = ok & visible(path, top)
    if config.one_file_system and {"dev", "root_dev"} <= set(files.columns):
        ok = ok & same_device(F.col("dev"), F.col("root_dev"))
    out = files.where(ok)
    if not few:
        out = exclude_folders(out, files.sparkSession.createDataFrame([(x,) for x in config.exclude], "path string"))
    return first_links(out) if {"dev", "ino"} <= set(files.columns) else out
