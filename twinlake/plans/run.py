"""One call from settings to groups, counters and a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.operators import filters, fuzzy, groups
from twinlake.plans.config import RunConfig
from twinlake.sources import tree
from twinlake.sources.content import with_facts


@dataclass
class Result:
    """``groups`` in long form, one row of ``metrics`` (by mode), and the ``plan`` of what is to be done, if any."""

    mode: str
    groups: DataFrame
    metrics: DataFrame
    plan: DataFrame | None


def run(files: DataFrame, config: RunConfig, target: DataFrame | None = None) -> Result:
    """Filter ``files``, group them as the settings say, and plan what is to be done with the groups.

    ``files`` has a ``content`` column, or is a scan of directories, whose files tasks then read in pieces. The single
    file is looked up in ``target``, a relation of the same kind, by default ``files`` before any filter."""
    found = filters.apply_filters(files, config.files)
    held = "content" in files.columns
    scan, mode = config.scan, config.mode
    readers = groups.column_readers(scan.algorithm) if held else groups.tree_readers(scan.algorithm)
    shown = reducible = None
    if mode == "fuzzy":
        least = max(scan.min_group, config.fuzzy.min_group)
        if held:
            metrics, near = fuzzy.fuzzy_metrics(found, config.fuzzy), fuzzy.fuzzy_groups(found, config.fuzzy)
        else:
            signed = with_facts(found.where(F.col("size") >= config.fuzzy.min_size), ("sig",), read_limit=config.fuzzy.read_limit)
            near, metrics = fuzzy.groups_of_signed(signed, config.fuzzy), found.agg(F.count("*").alias("scanned"), F.count_if(F.col("size") < config.fuzzy.min_size).alias("too_small"))
        shown = near.where(F.col("duplicate_count") >= least)
    elif mode == "name":
        shown, metrics = groups.name_groups(found, scan.min_group, config.name or None), groups.name_metrics(found, config.name or None)
    elif mode == "single":
        own = (files if target is None else target).where(F.col("path") == config.single_file)
        shown = groups.same_content(found, own, *readers)
        metrics = found.agg(F.count("*").alias("scanned"))
    else:
        done = groups.staged(found, *readers, scan.min_group)
        shown, metrics, reducible = done.groups, done.metrics, done.reducible()
    plan = None
    if config.keep:
        some = reducible if reducible is not None and config.keep_below_minimum else shown
        plan = groups.keep_plan(some, config.keep, config.action, config.single_file or None)
    return Result(mode, shown, metrics, plan)


def run_tree(spark: SparkSession, paths: list[str], config: RunConfig) -> Result:
    """``run`` over directories: what the settings leave out is not walked. A single file may lie outside of them."""
    target = tree.files_at(spark, [config.single_file]) if config.single_file else None
    return run(tree.scan(spark, paths, config=config.files), config, target)
