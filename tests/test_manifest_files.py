"""Manifests as files: numbered lines, and versions that appear whole or not at all."""

import json
import os

import pytest

from twinlake.operators.manifests import SCHEMA
from twinlake.sources import lines, sinks, versions


def entries(spark, *rows):
    return spark.createDataFrame([(1, g, "sha256", h, 4, "/x", p, None, None, None, None, None) for g, h, p in rows], SCHEMA)


def paths_of(spark, folder):
    return sorted(r.restore_path for r in sinks.read_manifest(spark, str(folder)).collect())


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_have_their_numbers_in_many_splits(spark, tmp_path, small_splits):
    for name, count in (("a", 400), ("b", 1), ("c", 90), ("e", 0)):
        (tmp_path / name).write_text("\n".join(f"{name}{k}" + "é" * (k % 7) if k % 5 else "" for k in range(count)))
    found = lines.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    want = {(name, k + 1, v) for name in "abce" for k, v in enumerate((tmp_path / name).read_text().splitlines())}
    assert {(os.path.basename(r.file), r.line, r.value) for r in found.collect()} == want


def test_errors_tell_the_line_of_a_large_file(spark, tmp_path, small_splits):
    good = lambda k: json.dumps({"version": 1, "hash": "aa", "restore_path": f"/r/{k}", "more": k})
    file = tmp_path / "m.jsonl"
    rows = [good(k) for k in range(300)]
    file.write_text("\n\n  \n" + "\n".join(rows) + "\n")
    back = sinks.read_manifest(spark, str(file))
    assert back.count() == 300 and back.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    for wrong, what in (('{"version": ', "line 254 is not an entry"), ("[1]", "line 254 is not an object"), ("null", "line 254 is not an object"), ('{"version": "x"}', "line 254 is not an entry"), (good("x" * 900), "line 254 is longer than 600 bytes")):
        file.write_text("\n\n  \n" + "\n".join(rows[:250] + [wrong] + rows[250:]))
        for read in (lambda d: d.count(), lambda d: d.where("restore_path = '/r/7'").collect()):
            with pytest.raises(Exception, match=what):
                read(sinks.read_manifest(spark, str(file), 600))


def test_append_adds_what_is_new(spark, tmp_path):
    m = tmp_path / "m"
    assert sinks.append_manifest(entries(spark, (2, "bb", "/q"), (1, "aa", "/q"), (1, "aa", "/p"), (3, "cc", "")), str(m)) == 1
    assert sinks.append_manifest(entries(spark, (9, "zz", "/p"), (4, "dd", "/s")), str(m)) == 2
    assert sinks.append_manifest(entries(spark, (9, "zz", "/p")), str(m)) == 0 == sinks.append_manifest(entries(spark), str(m))
    assert {(r.restore_path, r.hash) for r in sinks.read_manifest(spark, str(m)).collect()} == {("/p", "aa"), ("/q", "aa"), ("/s", "dd")}
    plain = tmp_path / "plain"
    sinks.write_manifest(entries(spark, (1, "aa", "/p")), str(plain))
    assert sinks.append_manifest(entries(spark, (9, "zz", "/p"), (4, "dd", "/s")), str(plain)) == 1 and paths_of(spark, plain) == ["/p", "/s"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/_versions").mkdir()
    assert paths_of(spark, tmp_path / "none") == [] and sinks.append_manifest(entries(spark, (1, "aa", "/p")), str(tmp_path / "none")) == 1


@pytest.mark.parametrize("step", ["before data", "data", "link"])
def test_stopped_between_any_two_steps(spark, tmp_path, monkeypatch, step):
    m = tmp_path / "m"
    sinks.append_manifest(entries(spark, (1, "aa", "/p")), str(m))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        if step == "before data":
            patch.setattr(sinks, "merge_manifests", stop)
        elif step == "data":
            patch.setattr(versions, "claim", stop)
        else:
            patch.setattr(versions.os, "link", stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.append_manifest(entries(spark, (2, "bb", "/q")), str(m))
    assert paths_of(spark, m) == ["/p"]
    assert sinks.append_manifest(entries(spark, (2, "bb", "/q"), (3, "cc", "/s")), str(m)) == 2 and paths_of(spark, m) == ["/p", "/q", "/s"]


@pytest.mark.parametrize("by", ["link", "rename"])
def test_two_writers_cannot_both_win(spark, tmp_path, monkeypatch, by):
    """Another writer commits between the reading and the commit of the first."""
    m, real, calls = tmp_path / "m", versions.claim, []
    if by == "rename":

        def link(source, target):
            path = spark._jvm.org.apache.hadoop.fs.Path
            versions.rename_new(spark, path("file://" + source), path("file://" + target))

        monkeypatch.setattr(versions.os, "link", link)

    def late(spark, folder, number, data):
        calls.append(number)
        if len(calls) == 1:
            monkeypatch.setattr(versions, "claim", real)
            assert sinks.append_manifest(entries(spark, (1, "other", "/p"), (1, "other", "/o")), folder) == 1
            monkeypatch.setattr(versions, "claim", late)
        return real(spark, folder, number, data)

    monkeypatch.setattr(versions, "claim", late)
    assert sinks.append_manifest(entries(spark, (1, "mine", "/p"), (1, "mine", "/q")), str(m)) == 2 and calls == [1, 2]
    assert {(r.restore_path, r.hash) for r in sinks.read_manifest(spark, str(m)).collect()} == {("/p", "other"), ("/o", "other"), ("/q", "mine")}
    assert sorted(n for n in os.listdir(m / "_versions") if not n.startswith("data-") and not n.startswith(".")) == ["00000001", "00000002"]
    assert len([n for n in os.listdir(m / "_versions") if n.startswith("data-")]) == 2
