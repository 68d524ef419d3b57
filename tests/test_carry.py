"""Plans carried out in tasks, which may be stopped anywhere, run again, or run twice at once."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from twinlake.operators import carry, groups, manifests
from twinlake.plans.config import RestoreConfig
from twinlake.sources import sinks, tree


def make(folder, count, copies=3):
    for k in range(count):
        for j in range(copies):
            f = folder / f"{k}" / f"f{j}"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(b"same%d" % k)


def plan_of(spark, folder, action="delete"):
    files = tree.with_content(tree.scan(spark, [str(folder)]))
    plan = groups.keep_plan(groups.content_groups(files), 1, action)
    return spark.createDataFrame(plan.collect(), plan.schema).repartition(5)


def left(folder):
    return sorted(f"{p.parent.name}/{p.name}" for p in folder.rglob("f*"))


def test_each_path_is_changed_once(spark, tmp_path):
    make(tmp_path / "d", 20)
    plan, journal = plan_of(spark, tmp_path / "d"), str(tmp_path / "journal")
    assert carry.counted(carry.carry_out(plan, journal)) == {"planned": 40} and not os.path.exists(journal) and len(left(tmp_path / "d")) == 60
    assert carry.counted(carry.carry_out(plan, journal, confirm=True)) == {"done": 40}
    assert left(tmp_path / "d") == sorted(f"{k}/f0" for k in range(20))
    (tmp_path / "d/3/f1").write_bytes(b"a new file of the same name")
    again = carry.carry_out(plan.union(plan), journal, confirm=True)
    assert carry.counted(again) == {"done": 40} and (tmp_path / "d/3/f1").exists()
    told = carry.outcomes_of(spark, journal)
    assert told.where("outcome = 'done' and action = 'delete'").count() == 40 == told.count()
    assert carry.carry_out(plan.limit(0), journal, confirm=True).count() == 0


@pytest.mark.parametrize("action", ["delete", "link"])
@pytest.mark.parametrize("step", ["claim", "change", "close"])
def test_stopped_between_any_two_steps(spark, tmp_path, monkeypatch, action, step):
    make(tmp_path, 1, 2)
    path, target, log = str(tmp_path / "0/f1"), str(tmp_path / "0/f0"), carry.Journal(str(tmp_path / "journal"))
    carried = lambda: carry.once(log, path, action, target, lambda: carry.change(path, action, target))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(*{"claim": (carry.os, "link"), "change": (carry, "change"), "close": (carry.Journal, "close")}[step], stop)
        with pytest.raises(KeyboardInterrupt):
            carried()
    assert carried() == "done" == carried()
    assert os.path.islink(path) and os.readlink(path) == target if action == "link" else not os.path.lexists(path)
    assert os.path.isfile(target) and not any("." in n for _, _, names in os.walk(tmp_path / "journal") for n in names)


def test_a_file_that_somebody_changed_is_left_alone(spark, tmp_path):
    make(tmp_path, 1, 3)
    log, path = carry.Journal(str(tmp_path / "journal")), str(tmp_path / "0/f1")
    log.claim(path, "delete")
    os.remove(path)
    (tmp_path / "0/f1").write_bytes(b"new work of a user")
    assert carry.once(log, path, "delete", None, lambda: carry.change(path, "delete", None)).startswith("error: changed") and os.path.exists(path)
    assert carry.once(log, path, "link", "/x", lambda: carry.change(path, "link", "/x")).startswith("error: the journal has another action") and not os.path.islink(path)
    gone = str(tmp_path / "0/none")
    assert carry.once(log, gone, "delete", None, lambda: carry.change(gone, "delete", None)).startswith("error")


@pytest.mark.parametrize("action", ["delete", "link"])
def test_tasks_that_run_twice_at_once(tmp_path, action):
    make(tmp_path, 60, 2)
    log, told = carry.Journal(str(tmp_path / "journal")), []
    gate = threading.Barrier(4)

    def task():
        gate.wait()
        for k in range(60):
            path, target = str(tmp_path / f"{k}/f1"), str(tmp_path / f"{k}/f0")
            told.append(carry.once(log, path, action, target, lambda: carry.change(path, action, target)))

    threads = [threading.Thread(target=task) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert told == ["done"] * 240
    for k in range(60):
        assert (tmp_path / f"{k}/f0").read_bytes() == b"same%d" % k
        assert os.readlink(tmp_path / f"{k}/f1") == str(tmp_path / f"{k}/f0") if action == "link" else not os.path.lexists(tmp_path / f"{k}/f1")


def test_a_run_that_fails_midway_goes_on(spark, tmp_path):
    make(tmp_path / "d", 12)
    plan, journal = plan_of(spark, tmp_path / "d", "link"), str(tmp_path / "journal")
    os.chmod(tmp_path / "d/4", 0o500)
    first = carry.counted(carry.carry_out(plan, journal, confirm=True))
    os.chmod(tmp_path / "d/4", 0o700)
    assert first == ({"done": 24} if os.geteuid() == 0 else {"done": 22, "error": 2})
    assert carry.counted(carry.carry_out(plan, journal, confirm=True)) == {"done": 24}
    assert all(os.path.islink(tmp_path / "d" / n) == (not n.endswith("f0")) for n in left(tmp_path / "d"))


def test_backup_and_restore_in_tasks(spark, tmp_path):
    make(tmp_path / "d", 6)
    os.chmod(tmp_path / "d/2/f1", 0o640)
    os.utime(tmp_path / "d/2/f1", ns=(5_000_000_007, 5_000_000_007))
    scanned = tree.with_content(tree.scan(spark, [str(tmp_path / "d")]))
    files = spark.createDataFrame(scanned.collect(), scanned.schema)
    marked, m = groups.auto_mark(groups.content_groups(files)), str(tmp_path / "m")
    with pytest.raises(ValueError, match="survive"):
        carry.carry_out_with_backup(manifests.backup_plan(groups.mark_all(marked), files), m, str(tmp_path / "j0"), confirm=True)
    assert not os.path.exists(m) and len(left(tmp_path / "d")) == 18
    assert carry.counted(carry.carry_out_with_backup(manifests.backup_plan(marked, files), m, str(tmp_path / "j1"), confirm=True)) == {"done": 12}
    entries = sinks.read_manifest(spark, m)
    state = files.where(F.col("path").endswith("f0")).select("path", F.lit("file").alias("kind"), "size", F.sha2("content", 256).alias("hash"))
    (tmp_path / "d/0/f0").write_bytes(b"other")
    state = state.withColumn("hash", F.when(F.col("path").endswith("/0/f0"), "00").otherwise(F.col("hash")))
    decisions = manifests.restore_decisions(entries, state)
    decisions = spark.createDataFrame(decisions.collect(), decisions.schema)
    assert carry.counted(carry.restore_in_tasks(entries, decisions, str(tmp_path / "j2"), True, RestoreConfig(dry_run=True))) == {"planned": 10, "left": 2}
    for _ in range(2):
        assert carry.counted(carry.restore_in_tasks(entries, decisions, str(tmp_path / "j2"), True)) == {"done": 10, "left": 2}
    s = os.stat(tmp_path / "d/2/f1")
    assert (tmp_path / "d/2/f1").read_bytes() == b"same2" and s.st_mode & 0o777 == 0o640 and s.st_mtime_ns == 5_000_000_007
    assert len(left(tmp_path / "d")) == 16
