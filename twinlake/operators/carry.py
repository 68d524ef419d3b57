"""Carries plans out in tasks. A journal of one record a path makes tasks that are run again, or twice at once, harmless."""

from __future__ import annotations

import filecmp
import hashlib
import json
import os
import shutil
import stat
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.plans.config import RestoreConfig
from twinlake.session import bound_batches
from twinlake.sources import sinks

#: Fixed value: the Linux request number that clones a file's extents.
FICLONE = 0x40049409
OUTCOMES = "path string, action string, outcome string"


def replace(path: str, make: Callable[[str], None]) -> None:
    """Make the new file under another name in the same folder, then rename: a failure leaves the old one."""
    spare = os.path.join(os.path.dirname(path), f".twinlake-{uuid.uuid4().hex}")
    try:
        make(spare)
        os.replace(spare, path)
    finally:
        if os.path.lexists(spare):
            os.remove(spare)


def clone(source: str, spare: str) -> None:
    import fcntl

    with open(source, "rb") as a, open(spare, "xb") as b:
        fcntl.ioctl(b.fileno(), FICLONE, a.fileno())
    shutil.copystat(source, spare)


def change(path: str, action: str, target: str | None) -> None:
    """Delete a file, or put a link to the target or a clone of it in its place."""
    if action == "delete":
        os.remove(path)
    elif action == "link":
        replace(path, lambda spare: os.symlink(target, spare))
    else:
        replace(path, lambda spare: clone(target, spare))


def put_back(path: str, canonical: str, mode: int | None, mtime: int | None, nsec: int | None, config: RestoreConfig) -> None:
    """Copy the canonical file to a path, with the permissions and times that are known and wanted."""
    os.makedirs(os.path.dirname(path), 0o750, exist_ok=True)

    def make(spare: str) -> None:
        with open(canonical, "rb") as a, open(spare, "xb") as b:
            shutil.copyfileobj(a, b)
            b.flush()
            os.fsync(b.fileno())
        own = mode if config.restore_mode else None
        os.chmod(spare, (own or os.stat(canonical).st_mode) & 0o777)
        if mtime and config.restore_mtime:
            t = mtime * 10**9 + (nsec or 0)
            os.utime(spare, ns=(t, t))

    replace(path, make)


def _identity(path: str) -> list[int] | None:
    """What tells a file from another that takes its place later; null where there is none."""
    try:
        s = os.lstat(path)
    except FileNotFoundError:
        return None
    return [s.st_dev, s.st_ino, stat.S_IFMT(s.st_mode), s.st_size, s.st_mtime_ns]


class Journal:
    """One record a path in a folder that all tasks see: what was there when the work was claimed, and its outcome once it
    is done. Records appear whole; of two claims one wins, and the other takes what that one saw."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _file(self, path: str) -> str:
        name = hashlib.sha256(os.fsencode(path)).hexdigest()
        return os.path.join(self.folder, name[:2], name)

    def _spare(self, file: str, record: dict) -> str:
        spare = f"{file}.{uuid.uuid4().hex}"
        with open(spare, "x", encoding="utf-8") as f:
            json.dump(record, f)
            f.flush()
            os.fsync(f.fileno())
        return spare

    def read(self, path: str) -> dict | None:
        try:
            with open(self._file(path), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def claim(self, path: str, action: str) -> dict:
        """The record of a path: a new one of what is there now, or the one that there is."""
        file = self._file(path)
        if (known := self.read(path)) is None:
            os.makedirs(os.path.dirname(file), 0o700, exist_ok=True)
            spare = self._spare(file, {"path": path, "action": action, "was": _identity(path)})
            try:
                os.link(spare, file)
            except FileExistsError:
                pass
            finally:
                os.remove(spare)
            known = self.read(path)
        if known["action"] != action:
            raise OSError(f"the journal has another action for this path: {known['action']}")
        return known

    def close(self, path: str, record: dict, outcome: str) -> str:
        file = self._file(path)
        os.replace(self._spare(file, record | {"outcome": outcome}), file)
        return outcome


def finished(path: str, action: str, target: str | None) -> bool:
    """Whether what stands at a path is what the work makes of it."""
    if action == "delete":
        return not os.path.lexists(path)
    if action == "link":
        return os.path.islink(path) and os.readlink(path) == target
    return os.path.isfile(path) and not os.path.islink(path) and filecmp.cmp(path, target, shallow=False)


def once(journal: Journal, path: str, action: str, target: str | None, work: Callable[[], None]) -> str:
    """Do the work on a path unless the journal tells that it is done; ``done``, or an error, after which it may be tried
    again.

    Where a claim has no outcome, its task was stopped or still runs. If the file is what it was at the claim, the work is
    done now. If it is not, it is left alone: it is what the work makes, which was done before it could be told, or
    somebody else has changed it, which is an error."""
    try:
        record = journal.claim(path, action)
        if "outcome" in record:
            return record["outcome"]
        if _identity(path) == record["was"]:
            try:
                work()
            except FileNotFoundError:
                # Another run of this task may have been faster.
                if record["was"] is None or not finished(path, action, target):
                    raise
        elif not finished(path, action, target):
            return "error: changed since it was claimed"
        return journal.close(path, record, "done")
    except OSError as e:
        return f"error: {e}"


def _in_tasks(rows: DataFrame, work: Callable[[dict], tuple[str, str, str]]) -> DataFrame:
    """``OUTCOMES`` of rows, the same path in one task, kept in the shared folder: read again, nothing is done again."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if told := [work(row) for row in batch.to_pylist()]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*told)], names=["path", "action", "outcome"])

    return cut(rows.mapInArrow(run, OUTCOMES))


def carry_out(plan: DataFrame, journal: str, confirm: bool = False) -> DataFrame:
    """``path, action, outcome`` of each row of a plan but those that are kept, the work done by tasks. Without ``confirm``
    all are ``planned`` and nothing is written.

    ``journal`` is a folder on a mount that all tasks see, as the files are; one folder serves one plan. Carrying the same
    plan out again with the same journal changes nothing more and tells the same outcomes; errors are tried again. Of rows
    that want different actions on one path one is carried out, the others are errors; equal rows count once."""
    rows = plan.where("action <> 'keep'").select("path", "action", "target").distinct()
    if not confirm:
        return rows.select("path", "action", F.lit("planned").alias("outcome"))
    log = Journal(os.path.abspath(journal))
    return _in_tasks(rows.repartition("path"), lambda r: (r["path"], r["action"], once(log, r["path"], r["action"], r["target"], lambda: change(r["path"], r["action"], r["target"]))))


def carry_out_with_backup(plan: DataFrame, folder: str, journal: str, confirm: bool = False) -> DataFrame:
    """``carry_out`` of a ``backup_plan`` after its entries are in the manifest in ``folder``, so all of it can be taken back.
    An error in any row, or a manifest that cannot be written, raises before any file is changed."""
    plan = cut(plan)
    bad = plan.where("error is not null").agg(F.min(F.struct("restore_path", "error")).alias("first")).first().first
    if bad:
        raise ValueError(f"nothing was done: {bad.error}: {bad.restore_path}")
    if confirm:
        sinks.append_manifest(plan.drop("action", "error"), folder)
    return carry_out(plan.select(F.col("restore_path").alias("path"), "action", F.col("canonical").alias("target")), journal, confirm)


def restore_in_tasks(entries: DataFrame, decisions: DataFrame, journal: str, confirm: bool = False, config: RestoreConfig = RestoreConfig()) -> DataFrame:
    """``path, action, outcome``: copies canonical files to where the decisions say; ``action`` is the decision. What the
    decisions skip or refuse has its reason as outcome."""
    rows = entries.join(decisions, "restore_path").select("restore_path", "decision", "reason", "canonical", "mode", "mtime_unix", "mtime_nsec")
    left = F.col("decision").isin("error", "skip")
    told = rows.where(left).select(F.col("restore_path").alias("path"), F.col("decision").alias("action"), F.col("reason").alias("outcome"))
    work = rows.where(~left)
    if not confirm or config.dry_run:
        return told.unionByName(work.select(F.col("restore_path").alias("path"), F.col("decision").alias("action"), F.lit("planned").alias("outcome")))
    log = Journal(os.path.abspath(journal))

    def put(r: dict) -> tuple[str, str, str]:
        path = r["restore_path"]
        return path, r["decision"], once(log, path, r["decision"], r["canonical"], lambda: put_back(path, r["canonical"], r["mode"], r["mtime_unix"], r["mtime_nsec"], config))

    told = cut(told)
    return told.unionByName(_in_tasks(work.repartition("restore_path"), put))


def counted(outcomes: DataFrame) -> dict[str, int]:
    """How many paths were done, planned, left or in error: all that the driver gets."""
    kind = F.when(F.col("outcome").isin("done", "planned"), F.col("outcome")).when(F.col("outcome").startswith("error:"), "error").otherwise("left")
    return {r.kind: r["count"] for r in outcomes.groupBy(kind.alias("kind")).count().collect()}


def outcomes_of(spark: SparkSession, journal: str) -> DataFrame:
    """``path, action, outcome`` that a journal tells, ``claimed`` where there is none yet: what was under way when a run
    was stopped."""
    rows = spark.read.schema("path string, action string, outcome string").json(f"file:{os.path.abspath(journal)}/*/{'[0-9a-f]' * 64}")
    return rows.select("path", "action", F.coalesce("outcome", F.lit("claimed")).alias("outcome"))
