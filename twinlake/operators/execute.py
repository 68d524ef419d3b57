"""Carries small plans out on the driver, one file after the other; ``carry`` has the same in tasks. Nothing happens without
``confirm``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.operators.carry import change, put_back
from twinlake.plans.config import RestoreConfig
from twinlake.sources import sinks


def apply_plan(plan: DataFrame, confirm: bool = False) -> list[tuple[str, str, str]]:
    """``(path, action, outcome)`` of each row of a plan but those that are kept; outcomes are ``planned``,
    ``done`` or an error, after which the rest goes on."""
    out = []
    for r in plan.where("action <> 'keep'").orderBy("hash", "path").toLocalIterator():
        outcome = "planned"
        if confirm:
            try:
                change(r.path, r.action, r.target)
                outcome = "done"
            except OSError as e:
                outcome = f"error: {e}"
        out.append((r.path, r.action, outcome))
    return out


#: What an action makes of a file, in words.
RESULT = {"delete": "removed", "link": "turned into a link", "reflink": "turned into a clone"}


def sentence(action: str, outcomes: list[tuple[str, str, str]]) -> str:
    """One line that says how many files an action changed, and how many it could not change."""
    done, failed = (sum(x[2].startswith(w) for x in outcomes) for w in ("done", "error"))
    files = lambda n: f"{n} file" if n == 1 else f"{n} files"
    if not done and not failed:
        return f"Nothing to do: no file was {RESULT[action]}"
    text = f"{files(done)} {RESULT[action]}"
    return f"{text}, {files(failed)} left as before after errors" if failed else text


def apply_with_backup(plan: DataFrame, folder: str, confirm: bool = False) -> list[tuple[str, str, str]]:
    """Carries out a ``backup_plan`` after its entries are in the manifest in ``folder``, so all of it can be taken
    back. An error in any row, or a manifest that cannot be written, raises before any file is changed."""
    plan = cut(plan)
    bad = plan.where("error is not null").orderBy("hash", "restore_path").first()
    if bad:
        raise ValueError(f"nothing was done: {bad.error}: {bad.restore_path}")
    if confirm:
        sinks.append_manifest(plan.drop("action", "error"), folder)
    return apply_plan(plan.select("hash", F.col("restore_path").alias("path"), "action", F.col("canonical").alias("target")), confirm)


def restore(entries: DataFrame, decisions: DataFrame, confirm: bool = False, config: RestoreConfig = RestoreConfig()) -> list[tuple[str, str, str]]:
    """``(path, decision, outcome)``: copies canonical files to where the decisions say."""
    out = []
    for r in entries.join(decisions, "restore_path").orderBy("restore_path").toLocalIterator():
        outcome = r.reason if r.decision in ("error", "skip") else "planned"
        if confirm and not config.dry_run and outcome == "planned":
            try:
                put_back(r.restore_path, r.canonical, r.mode, r.mtime_unix, r.mtime_nsec, config)
                outcome = "done"
            except OSError as e:
                outcome = f"error: {e}"
        out.append((r.restore_path, r.decision, outcome))
    return out
