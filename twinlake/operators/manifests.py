"""Backup manifests and restore decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.operators.groups import numbered, survivors
from twinlake.plans.config import RestoreConfig

SCHEMA = "version int, group_id long, hash_algo string, hash string, size long, canonical string, restore_path string, mode long, mtime_unix long, mtime_nsec long, dev long, ino long"


#: What a restore gives back to a file.
FACTS = ["mode", "mtime_unix", "mtime_nsec", "dev", "ino"]


def with_facts(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Entries with the permissions, times and identity that ``meta`` (a scan: ``path`` and ``FACTS``) has of the
    file to be restored; null where it has none."""
    facts = meta.select(F.col("path").alias("restore_path"), F.col("mode").bitwiseAND(F.lit(0o777)).cast("long").alias("mode"), *FACTS[1:])
    return entries.join(facts, "restore_path", "left").select(*entries.columns, *FACTS)


def manifest_entries(groups: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """An entry per file but the smallest path of its group, which is the canonical one; groups are
    numbered by digest. With ``meta``, a scan of the files, also what a restore needs of each."""
    heads = groups.groupBy("hash").agg(F.min("path").alias("canonical"))
    ranked = numbered(heads, "hash", "group_id")
    rows = groups.join(ranked, "hash").where("path <> canonical")
    out = rows.select(
        F.lit(1).alias("version"), "group_id", F.lit("sha256").alias("hash_algo"), "hash", F.col("size_bytes").alias("size"), "canonical", F.col("path").alias("restore_path")
    ).distinct()
    return out if meta is None else with_facts(out, meta)


def backup_plan(marked: DataFrame, meta: DataFrame, action: str = "delete") -> DataFrame:
    """The manifest entry of each marked file, its ``action`` and an ``error`` or null. ``meta`` is a scan of what is
    there now. An error in any row means that nothing may be done: a group without a surviving file, a survivor
    that is missing or not a regular file, or a marked file that is neither that nor a link."""
    kept = survivors(marked)
    ranked = numbered(kept.select("hash").distinct(), "hash", "group_id")
    kind = lambda c: F.col(c).bitwiseAND(F.lit(0o170000))
    heads = meta.select(F.col("path").alias("canonical"), F.col("mode").alias("c_mode"), F.col("size").alias("size"))
    own = meta.select(F.col("path").alias("restore_path"), F.col("mode").alias("r_mode"), *FACTS[1:])
    rows = marked.where("marked").select("hash", F.col("path").alias("restore_path")).join(kept.withColumnRenamed("target", "canonical"), "hash").join(ranked, "hash")
    rows = rows.join(heads, "canonical", "left").join(own, "restore_path", "left")
    error = (
        F.when(F.col("canonical").isNull(), "no file of the group would survive")
        .when(F.col("c_mode").isNull() | (kind("c_mode") != 0o100000), "the surviving file is missing or not regular")
        .when(F.col("r_mode").isNull() | ~kind("r_mode").isin(0o100000, 0o120000), "a marked file is missing, or neither a file nor a link")
    )
    mode = F.col("r_mode").bitwiseAND(F.lit(0o777)).cast("long").alias("mode")
    head = [F.lit(1).alias("version"), F.col("group_id"), F.lit("sha256").alias("hash_algo"), F.col("hash")]
    return rows.select(*head, "size", "canonical", "restore_path", mode, *FACTS[1:], F.lit(action).alias("action"), error.alias("error"))


def merge_manifests(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entries by ``restore_path``; what exists wins, then the smallest ``(group_id, hash)``. Entries without a
    path are dropped."""
    columns = existing.columns
    both = existing.withColumn("source", F.lit(0)).unionByName(incoming.withColumn("source", F.lit(1)), allowMissingColumns=True)
    entry = F.struct(*[c for c in columns if c != "restore_path"])
    best = both.where("restore_path <> ''").groupBy("restore_path").agg(F.min_by(entry, F.struct("source", "group_id", "hash")).alias("entry"))
    return best.select("entry.*", "restore_path").select(columns)


def restore_decisions(entries: DataFrame, state: DataFrame, config: RestoreConfig = RestoreConfig()) -> DataFrame:
    """``(restore_path, decision, reason)`` from entries and the ``state`` of paths: ``path, kind ('file',
    'symlink', 'other'), size, hash``; a path that is not in ``state`` does not exist."""
    c = state.select(F.col("path").alias("canonical"), F.col("kind").alias("c_kind"), F.col("size").alias("c_size"), F.col("hash").alias("c_hash"))
    r = state.select(F.col("path").alias("restore_path"), F.col("kind").alias("r_kind"), F.col("size").alias("r_size"), F.col("hash").alias("r_hash"))
    rows = entries.join(c, "canonical", "left").join(r, "restore_path", "left")

    def same(size: str, digest: str):
        sized = (F.col("size") < 0) | F.col("size").isNull() | (F.col("size") == F.col(size))
        return sized & F.coalesce(F.lower(F.col("hash")) == F.lower(F.col(digest)), F.lit(False))

    rules = [
        (~F.coalesce(F.col("version"), F.lit(0)).isin(0, 1), "error", "unknown version"),
        ((F.coalesce(F.col("canonical"), F.lit("")) == "") | (F.coalesce(F.col("restore_path"), F.lit("")) == ""), "error", "a path is missing"),
        (~F.lower(F.coalesce(F.col("hash_algo"), F.lit(""))).isin("", "sha256", "blake3"), "error", "unknown hash algorithm"),
        (F.coalesce(F.col("c_kind"), F.lit("")) != "file", "error", "the canonical file is missing or not regular"),
        (F.lit(config.verify_hash) & ~same("c_size", "c_hash"), "error", "the canonical file has changed"),
        (F.col("r_kind") == "symlink", "replace", "a link is in its place"),
        (F.col("r_kind") == "other", "error", "something else is in its place"),
        ((F.col("r_kind") == "file") & same("r_size", "r_hash"), "skip", "already there"),
        ((F.col("r_kind") == "file") & F.lit(not config.overwrite), "error", "another file is there and may not be overwritten"),
        (F.col("r_kind") == "file", "replace", "differs"),
    ]
    decision, reason = F.lit("copy"), F.lit("missing")
    for test, what, why in reversed(rules):
        decision, reason = F.when(test, what).otherwise(decision), F.when(test, why).otherwise(reason)
    return rows.select("restore_path", decision.alias("decision"), reason.alias("reason"))
