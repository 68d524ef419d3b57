"""Runs from settings, pruned walks and long lists of excluded folders."""

import os
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinlake.operators import filters
from twinlake.plans.config import FuzzyConfig, RunConfig, ScanConfig, check_modes
from twinlake.plans.run import run, run_tree
from twinlake.sources import tree


def make(folder, rows):
    for name, data in rows.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


TREE = {"a/x.txt": b"same", "b/x.txt": b"same", "b/y.txt": b"same", ".h/x.txt": b"same", "c/.env": b"same", "c/z.txt": b"other!", "skip/x.txt": b"same"}


def test_each_mode_from_settings(spark, tmp_path):
    make(tmp_path, TREE)
    paths, scan = [str(tmp_path)], ScanConfig(exclude=[str(tmp_path / "skip")])
    done = run_tree(spark, paths, RunConfig(scan=scan, keep=1))
    assert done.mode == "content" and names(done.groups, tmp_path) == ["a/x.txt", "b/x.txt", "b/y.txt"]
    assert {(os.path.relpath(r.path, tmp_path), r.action) for r in done.plan.collect()} == {("a/x.txt", "keep"), ("b/x.txt", "delete"), ("b/y.txt", "delete")}
    assert done.metrics.first().scanned == 4
    assert names(run_tree(spark, paths, RunConfig(scan=replace(scan, hidden=True))).groups, tmp_path) == [".h/x.txt", "a/x.txt", "b/x.txt", "b/y.txt", "c/.env"]
    by_name = run_tree(spark, paths, RunConfig(scan=scan, name_only=True))
    assert by_name.mode == "name" and names(by_name.groups, tmp_path) == ["a/x.txt", "b/x.txt"] and by_name.plan is None
    assert names(run_tree(spark, paths, RunConfig(scan=scan, file_name="y.txt")).groups, tmp_path) == []
    assert names(run_tree(spark, paths, RunConfig(scan=scan, name_only=True, single_file=str(tmp_path / "skip/x.txt"))).groups, tmp_path) == ["a/x.txt", "b/x.txt"]
    one = run_tree(spark, paths, RunConfig(scan=scan, single_file=str(tmp_path / "skip/x.txt"), keep=1, action="link"))
    assert one.mode == "single" and names(one.groups, tmp_path) == ["a/x.txt", "b/x.txt", "b/y.txt", "skip/x.txt"]
    assert {r.target for r in one.plan.where("action = 'link'").collect()} == {str(tmp_path / "skip/x.txt")}
    hidden = run_tree(spark, paths, RunConfig(scan=scan, single_file=str(tmp_path / "c/.env")))
    assert ".h/x.txt" in names(hidden.groups, tmp_path)  # a hidden target switches hidden files on
    assert run_tree(spark, paths, RunConfig(scan=scan, single_file=str(tmp_path / "c/z.txt"))).groups.count() == 0
    assert run_tree(spark, paths, RunConfig(scan=scan, single_file=str(tmp_path / "none"))).groups.count() == 0
    blake = run_tree(spark, paths, RunConfig(scan=replace(scan, algorithm="blake3", min_group=3)))
    assert names(blake.groups, tmp_path) == ["a/x.txt", "b/x.txt", "b/y.txt"]


def test_near_content_of_a_tree_is_that_of_its_contents(spark, tmp_path):
    text = b"alpha beta gamma delta epsilon zeta eta theta iota kappa lambda " * 40
    make(tmp_path, {"a.txt": text, "b.txt": text + b"lambdA", "c.md": text, "d.txt": bytes(range(256)) * 10, "e.txt": b"small"})
    config = RunConfig(scan=ScanConfig(), fuzzy=FuzzyConfig(threshold=90, min_size=100, same_extension=True))
    of_tree = run_tree(spark, [str(tmp_path)], config)
    held = tree.with_content(tree.scan(spark, [str(tmp_path)]))
    assert names(of_tree.groups, tmp_path) == ["a.txt", "b.txt"] and of_tree.mode == "fuzzy"
    assert sorted(map(tuple, of_tree.groups.collect())) == sorted(map(tuple, run(held, config).groups.collect()))


def test_settings_that_clash():
    bad = [
        dict(file_name="x", single_file="/x"), dict(name_only=True, backup=True), dict(fuzzy=FuzzyConfig(), keep=1), dict(fuzzy=FuzzyConfig(), name_only=True),
        dict(action="burn"), dict(keep=-1), dict(file_name="/"), dict(name_only=True, single_file="/"),
    ]
    for settings in bad:
        with pytest.raises(ValueError):
            RunConfig(**settings)
    check_modes(name_only=True, single_file=True)
    with pytest.raises(ValueError):
        check_modes(restore=True, file_name=True)


def test_plans_below_the_least_size_of_a_group(spark):
    head = b"x" * 5000
    rows = [("/a", head + b"1"), ("/b", head + b"1"), ("/c", head + b"2"), ("/d", b"s"), ("/e", b"s")]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, size long, content binary")
    config = RunConfig(scan=ScanConfig(min_group=3), keep=1)
    assert run(files, config).plan.count() == run(files, config).groups.count() == 0
    plan = run(files, replace(config, keep_below_minimum=True)).plan
    assert {(r.path, r.action) for r in plan.collect()} == {("/a", "keep"), ("/b", "delete")}  # the short pair had no three of a size


def test_what_settings_leave_out_is_never_listed(tmp_path, monkeypatch):
    make(tmp_path, {"a/b/c/1": b"1", "skip/deep/2": b"2", ".git/3": b"3", "proc/4": b"4", "root": b"5"})
    listed = []
    real = tree._listing
    monkeypatch.setattr(tree, "_listing", lambda folder: listed.append(os.path.relpath(folder, tmp_path)) or real(folder))

    def walk(pruned, root=tmp_path):
        listed.clear()
        start = pd.DataFrame({"path": [str(root)], "root": [str(root)], "root_dev": pd.array([None], "Int64"), "depth": pd.array([0], "Int64")})
        found = [p for out in tree._walk(iter([start]), pruned, 1000) for p in out["path"]]
        return sorted(os.path.relpath(p, tmp_path) for p in found), sorted(listed)

    virtual = [str(tmp_path / "proc")]
    monkeypatch.setattr(tree, "VIRTUAL", virtual)
    pruned = tree.Pruned.by(ScanConfig(exclude=[str(tmp_path / "skip") + "/"]))
    assert walk(pruned) == (["a/b/c/1", "root"], [".", "a", "a/b", "a/b/c"])
    assert walk(tree.Pruned.by(ScanConfig(max_depth=0)))[1] == ["."]
    assert walk(tree.Pruned.by(ScanConfig(hidden=True, virtual=True)))[1] == [".", ".git", "a", "a/b", "a/b/c", "proc", "skip", "skip/deep"]
    assert walk(pruned, tmp_path / "skip/deep") == ([], [])  # a root below an excluded folder
    other = os.lstat

    def lstat(path, **how):
        s = other(path, **how)
        return os.stat_result([*s[:2], s.st_dev + 1, *s[3:]]) if str(path).endswith("/a") else s

    monkeypatch.setattr(tree.os, "lstat", lstat)
    assert "a" not in walk(tree.Pruned.by(ScanConfig(one_file_system=True)))[1]


def test_many_excluded_folders(spark):
    rows = [(f"/top/{k}/file",) for k in range(2000)] + [("/top",), ("/topper/x",), ("/",), ("/top/7",), ("/a/b",), (None,)]
    files = spark.createDataFrame(rows, "path string")
    folders = [f"/top/{k}/" for k in range(0, 100_000, 2)] + ["/a/b/c", "", "/topper/x"]
    given = spark.createDataFrame([(x,) for x in folders], "path string")
    got = {r.path for r in filters.exclude_folders(files, given).collect()}
    want = {p for (p,) in rows if p != "/topper/x" and not (p and p.startswith("/top/") and int(p.split("/")[2]) % 2 == 0)}
    assert got == want
    plan = filters.exclude_folders(files, given)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
    assert filters.exclude_folders(files, given.limit(0)).count() == len(rows)
    assert [r.path for r in filters.exclude_folders(files.where("path is not null"), spark.createDataFrame([("/",)], "path string")).collect()] == []
    few = [f"/top/{k}" for k in range(0, 40)]
    sized = files.where("path is not null").withColumn("size", F.lit(1))
    assert {r.path for r in filters.apply_filters(sized, ScanConfig(exclude=few, hidden=True)).collect()} == {r.path for r in sized.where(filters.not_excluded(F.col("path"), few)).collect()}
