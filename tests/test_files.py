import functools
import itertools
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.functions.simhash import max_distance
from twinlake.operators import execute, filters, fuzzy, groups, manifests
from twinlake.operators.components import connected_components
from twinlake.plans.config import FuzzyConfig, RestoreConfig, ScanConfig
from twinlake.sources import sinks, tree


def files_of(spark, rows):
    return spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, size long, content binary")


def make(folder, rows):
    for name, content in rows.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_scan_and_depth(spark, tmp_path):
    make(tmp_path, {"root.txt": b"1", "level1/one.txt": b"2", "level1/level2/two.txt": b"3", ".hidden.txt": b"4", "_under": b"5"})
    os.symlink(tmp_path / "root.txt", tmp_path / "link")
    os.link(tmp_path / "root.txt", tmp_path / "again.txt")
    names = lambda df: sorted(os.path.basename(r.path) for r in df.collect())
    seen = tree.scan(spark, [str(tmp_path)])
    assert names(seen) == [".hidden.txt", "_under", "again.txt", "one.txt", "root.txt", "two.txt"]
    assert names(filters.apply_filters(seen, ScanConfig())) == ["_under", "again.txt", "one.txt", "two.txt"]
    assert names(tree.scan(spark, [str(tmp_path)], 0)) == [".hidden.txt", "_under", "again.txt", "root.txt"]
    assert names(filters.apply_filters(seen, ScanConfig(max_depth=1, exclude=[str(tmp_path / "level1")]))) == ["_under", "again.txt"]
    assert {bytes(r.content) for r in tree.with_content(seen).collect()} == {b"1", b"2", b"3", b"4", b"5"}


def test_staged_and_direct_agree(spark):
    big = b"x" * 5000
    rows = [("/a", b"1"), ("/b", b"1"), ("/c", big + b"1"), ("/d", big + b"2"), ("/e", big + b"1"), ("/f", b"2"), ("/g", b""), ("/h", b"")]
    files = files_of(spark, rows)
    direct = {tuple(r) for r in groups.content_groups(files).collect()}
    assert direct == {tuple(r) for r in groups.staged_groups(files).collect()}
    assert {r[4] for r in direct} == {"/a", "/b", "/c", "/e", "/g", "/h"}
    assert groups.stage_metrics(files).first().asDict() == {"scanned": 8, "sampled": 8, "fully_hashed": 3, "skipped_by_size": 0, "skipped_by_sample": 1}
    assert groups.content_groups(files.limit(0)).count() == 0


def test_keep_plan_in_a_large_group(spark):
    found = groups.content_groups(files_of(spark, [(f"/{k:04}", b"same") for k in range(300)]))
    plan = groups.keep_plan(found, 3).orderBy("path").collect()
    assert [r.path for r in plan if r.action == "keep"] == ["/0000", "/0001", "/0002"]
    assert len(plan) == 300
    for bad in (lambda: groups.keep_plan(found, 0), lambda: groups.keep_plan(found, 1, "burn")):
        with pytest.raises(ValueError):
            bad()


def test_marks_without_a_survivor(spark):
    marked = groups.auto_mark(groups.content_groups(files_of(spark, [("/a", b"1"), ("/b", b"1")])))
    assert groups.mark_plan(marked, "link").first().target == "/a"
    assert groups.mark_plan(marked.withColumn("marked", F.lit(True)), "link").first().error


def test_sinks(spark, tmp_path):
    found = groups.content_groups(files_of(spark, [('/q"<1>', b"1"), ("/b", b"1"), ("/c", b"2")]))
    sinks.write_csv(found, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text().splitlines()[0] == "match_type,match_key,hash,duplicate_count,path,size_bytes"
    sinks.write_json(found, str(tmp_path / "o.json"))
    text = (tmp_path / "o.json").read_text()
    assert "<" not in text and json.loads(text)["groups"][0]["files"] == [{"path": "/b", "size": 1}, {"path": '/q"<1>', "size": 1}]
    sinks.write_json(found.limit(0), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == {"group_count": 0, "groups": []}
    assert list(sinks.text_lines(found))[1:] == [" 1: /b", ' 2: /q"<1>']


def test_backup_delete_restore(spark, tmp_path):
    make(tmp_path / "d", {"c": b"same", "b": b"same", "a": b"same", "z": b"other"})
    files = tree.with_content(tree.scan(spark, [str(tmp_path / "d")]))
    found = groups.content_groups(files)
    entries = manifests.manifest_entries(found)
    sinks.write_manifest(entries, str(tmp_path / "m"))
    back = sinks.read_manifest(spark, str(tmp_path / "m"))
    assert [(os.path.basename(r.canonical), os.path.basename(r.restore_path)) for r in back.orderBy("restore_path").collect()] == [("a", "b"), ("a", "c")]
    plan = groups.keep_plan(found)
    assert {x[2] for x in execute.apply_plan(plan)} == {"planned"} and (tmp_path / "d/b").exists()
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    assert {x[2] for x in execute.apply_plan(plan, confirm=True)} == {"done"} and not (tmp_path / "d/b").exists()
    (tmp_path / "d/c").write_bytes(b"changed")
    now = tree.with_content(tree.scan(spark, [str(tmp_path / "d")]))
    state = now.select("path", F.lit("file").alias("kind"), "size", F.sha2("content", 256).alias("hash"))
    decisions = manifests.restore_decisions(back, state)
    assert {(os.path.basename(r.restore_path), r.decision) for r in decisions.collect()} == {("b", "copy"), ("c", "error")}
    decisions = manifests.restore_decisions(back, state, RestoreConfig(overwrite=True))
    decisions = spark.createDataFrame(decisions.collect(), decisions.schema)
    execute.restore(back, decisions, confirm=True)
    assert (tmp_path / "d/b").read_bytes() == (tmp_path / "d/c").read_bytes() == b"same"


def test_staged_runs_hold_no_files_that_the_filter_lets_pass(spark, monkeypatch):
    alike = [(f"/a{k}", b"x" * 5000 + str(k % 2).encode()) for k in range(4)]
    alone = [("/b", b"y" * 5001), ("/c", b"z" * 6000)]
    monkeypatch.setattr(groups, "marked_rows", lambda rows, wanted, keys: rows)  # a filter may let any other row pass
    run = groups.staged_content(files_of(spark, alike + alone), 3)
    assert sorted(r.path for r in run.held.collect()) == [p for p, _ in alike]
    assert tuple(run.counts().first()) == (0, 2)


def test_merge_keeps_what_exists(spark):
    row = lambda g, h, p: (1, g, "sha256", h, 4, "/x", p, None, None, None, None, None)
    old = spark.createDataFrame([row(1, "aa", "/p"), row(3, "cc", "")], manifests.SCHEMA)
    new = spark.createDataFrame([row(1, "bb", "/p"), row(2, "bb", "/q"), row(2, "bb", "/q")], manifests.SCHEMA)
    assert {(r.restore_path, r.hash) for r in manifests.merge_manifests(old, new).collect()} == {("/p", "aa"), ("/q", "bb")}


def test_fuzzy_queries_sign_whole_texts(spark, monkeypatch):
    from twinlake import queries
    from twinlake.functions.simhash import signature

    head, tails = "a" * 300_000, ["xyzw" * 300_000, "mnop" * 300_000]
    files = files_of(spark, [(f"/{k}", (head + t).encode()) for k, t in enumerate(tails)])
    monkeypatch.setattr(queries, "files_of", lambda spark, sf_dir: files)
    assert {r.sig for r in queries.fuzzy_signature(spark, "").collect()} == {signature((head + t).encode()) for t in tails}
    assert queries.fuzzy_groups(spark, "").count() == 0 and FuzzyConfig(read_limit=-1).read_limit == -1 and FuzzyConfig(read_limit=0).read_limit == 256 * 1024


def test_workers_of_near_content_get_small_batches_and_give_memory_back(spark, monkeypatch):
    import pandas as pd
    import pyarrow as pa

    from twinlake.functions import simhash
    from twinlake.operators import components
    from twinlake.session import BATCH_BYTES

    own = spark.newSession()
    fuzzy.signatures(files_of(own, [("/a", b"abcd")]))
    assert own.conf.get(BATCH_BYTES) == "4m"
    told = []
    for module in (fuzzy, simhash, components):
        monkeypatch.setattr(module, "give_back", lambda name=module.__name__: told.append(name))
    list(fuzzy._meet(iter([]), 3, 2.0))
    assert [len(x) for x in simhash._signatures.func(iter([pd.Series([b"abcd", None])] * 2))] == [2, 2]
    assert [x.num_rows for x in components.contracted(iter([pa.RecordBatch.from_pydict({"u": ["b"], "v": ["a"]})]))] == [1]
    assert told == [m.__name__ for m in (fuzzy, simhash, components)]


@pytest.mark.parametrize("threshold", [89, 95, 96, 97])
def test_crowded_bands_are_told_apart_and_lose_no_pair(spark, monkeypatch, threshold):
    rng, distance = np.random.default_rng(threshold), max_distance(threshold)
    sigs = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    sigs = [x >> 20 << 20 | 0xABCDE if k % 2 else x & ((1 << 40) - 1) | 0x5A5A << 48 for k, x in enumerate(sigs)]
    for k in range(450):  # near copies, at the distance and one beyond
        sigs.append(functools.reduce(lambda a, b: a ^ 1 << int(b), rng.choice(63, distance + k % 2, replace=False), sigs[int(rng.integers(len(sigs)))]))
    rows = [(f"/{k:03}", int(rng.choice([90, 100, 210])), "", x) for k, x in enumerate(sigs)]
    table, config = spark.createDataFrame(rows, "path string, size long, ext string, sig long"), FuzzyConfig(threshold=threshold, max_candidates=-1, min_size=0)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (p, n, _, x), (q, m, _, y) in itertools.combinations(rows, 2):
        if (x ^ y).bit_count() <= distance and max(n, m) <= config.max_ratio * min(n, m):
            a, b = sorted((root(p), root(q)))
            parent[b] = a
    want = {p: root(p) for p in parent}
    want = {p: c for p, c in want.items() if sum(x == c for x in want.values()) > 1}
    monkeypatch.setattr(fuzzy, "CROWD", 6)
    monkeypatch.setattr(fuzzy, "PIECE", 5)
    assert {r.path: r.component for r in fuzzy.members_of_signed(table, config).collect()} == want


def test_signatures_that_share_a_band_do_not_all_meet(spark):
    rows = spark.range(20_000).select(F.format_string("/%d", "id").alias("path"), F.lit(100).cast("long").alias("size"), F.lit("").alias("ext"), F.xxhash64("id").bitwiseAND(F.lit(~0xFFFF)).alias("sig"))
    told = fuzzy.candidates(rows, FuzzyConfig(threshold=95, max_candidates=-1, min_size=0)).first()
    assert told.nodes == 20_000 and told.pairs_met < told.all_pairs / 50 and told.copies < 40 * 20_000


@pytest.mark.parametrize("threshold, piece, large", [(85, 1024, 32), (85, 3, 2), (95, 2, 2), (75, 1024, 2), (75, 3, 2), (60, 2, 3)])
def test_fuzzy_groups_match_all_pairs(spark, monkeypatch, threshold, piece, large):
    import random

    monkeypatch.setattr(fuzzy, "PIECE", piece)
    monkeypatch.setattr(fuzzy, "LARGE", large)
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(rng.choice([30, 60, 200]))) for _ in range(12)]
    rows = [(f"/{k}/{j}.txt", (text + " x" * j).encode()) for k, text in enumerate(base) for j in range(4)] + [("/empty", b"")]
    files, config = files_of(spark, rows), FuzzyConfig(threshold=threshold, min_size=0)
    sigs = {r.path: (r.sig, r.size) for r in fuzzy.signatures(files, config).collect()}
    parent = {p: p for p in sigs}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in sigs:
        for b in sigs:
            (s, n), (t, m) = sigs[a], sigs[b]
            if ((s ^ t) % 2**64).bit_count() <= (100 - threshold) * 64 // 100 and max(n, m) <= 2 * min(n, m):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {p: find(p) for p in sigs}
    sizes = list(want.values())
    got = {r.path: r.component for r in fuzzy.fuzzy_members(files, config).collect()}
    assert got == {p: c for p, c in want.items() if sizes.count(c) > 1} and got
    assert fuzzy.fuzzy_groups(files.limit(0), config).count() == 0
    told = fuzzy.candidates(fuzzy.signatures(files, config), config).first()
    assert told.nodes == len(set(sigs.values())) and told.all_pairs == told.nodes * (told.nodes - 1) // 2
    assert 0 < told.pairs_met < told.all_pairs or threshold == 95


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (1, 1), (None, 2), (3, 5)], "src long, dst long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(5, 3), (4, 3), (3, 3), (9, 8), (8, 8)}
    assert connected_components(edges.limit(0)).count() == 0


def test_roots_of_numbered_nodes_are_those_of_single_steps():
    import numpy as np

    from twinlake.operators.components import roots

    rng = np.random.default_rng(4)
    for n, m in [(1, 0), (3, 1), (30, 20), (30, 60), (400, 380), (400, 300)] * 10:
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        least = list(range(n))
        for _ in range(n):
            before = list(least)
            for x, y in zip(a.tolist(), b.tolist()):
                least[x] = least[y] = min(least[x], least[y])
            if least == before:
                break
        assert roots(a, b, n).tolist() == least
    path = rng.permutation(50_000)
    assert not roots(path[:-1], path[1:], len(path)).any()


def test_components_over_many_tasks(spark, monkeypatch):
    """Chains, stars and cycles that no single task sees whole."""
    import random

    from twinlake.operators import components

    monkeypatch.setattr(components, "EDGES", 40)
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(200, 200 + k) for k in range(1, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    rng.shuffle(pairs)
    parent = {x: x for p in pairs if p[0] != p[1] for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        if x != y:
            low, high = sorted((find(x), find(y)))
            parent[high] = low
    for kind in ("string", "long"):
        name = (lambda x: f"{x:05}") if kind == "string" else int
        frame = spark.createDataFrame([(name(x), name(y)) for x, y in pairs], f"src {kind}, dst {kind}").repartition(7)
        assert {(r.node, r.component) for r in connected_components(frame).collect()} == {(name(x), name(find(x))) for x in parent}


def scanned(spark, folder):
    """What a scan finds now, as rows that stay when files change."""
    files = tree.with_content(tree.scan(spark, [str(folder)]))
    return spark.createDataFrame(files.collect(), files.schema)


def test_backup_is_written_before_anything_is_changed(spark, tmp_path):
    make(tmp_path / "d", {"a": b"same", "b": b"same", "c": b"same", "x": b"two", "y": b"two"})
    os.chmod(tmp_path / "d/b", 0o640)
    os.utime(tmp_path / "d/b", ns=(5_000_000_007, 5_000_000_007))
    files = scanned(spark, tmp_path / "d")
    marked = groups.auto_mark(groups.content_groups(files))
    plan, manifest = manifests.backup_plan(marked, files), str(tmp_path / "m")
    assert {x[2] for x in execute.apply_with_backup(plan, manifest)} == {"planned"} and not os.path.exists(manifest)
    first = plan.where(F.col("restore_path").endswith("/b"))
    outcomes = execute.apply_with_backup(first, manifest, confirm=True)
    assert execute.sentence("delete", outcomes) == "1 file removed" and not (tmp_path / "d/b").exists()
    (tmp_path / "d/b").write_bytes(b"")
    execute.apply_with_backup(plan, manifest, confirm=True)
    back = sinks.read_manifest(spark, manifest)
    assert sorted(os.path.basename(r.restore_path) for r in back.collect()) == ["b", "c", "y"] and sorted(os.listdir(tmp_path / "d")) == ["a", "x"]
    assert [(r.mode, r.mtime_unix, r.mtime_nsec) for r in back.where(F.col("restore_path").endswith("/b")).collect()] == [(0o640, 5, 7)]
    now = scanned(spark, tmp_path / "d")
    state = now.select("path", F.lit("file").alias("kind"), "size", F.sha2("content", 256).alias("hash"))
    decisions = manifests.restore_decisions(back, state)
    assert {x[2] for x in execute.restore(back, decisions, confirm=True, config=RestoreConfig(dry_run=True))} == {"planned"}
    assert {x[2] for x in execute.restore(back, decisions, confirm=True)} == {"done"}
    s = os.stat(tmp_path / "d/b")
    assert (tmp_path / "d/b").read_bytes() == b"same" and s.st_mode & 0o777 == 0o640 and s.st_mtime_ns == 5_000_000_007


def test_backup_aborts_before_any_change(spark, tmp_path):
    make(tmp_path / "d", {"a": b"same", "b": b"same", "x": b"two", "y": b"two"})
    files = scanned(spark, tmp_path / "d")
    marked = groups.auto_mark(groups.content_groups(files))
    everything = groups.mark_all(marked)
    with pytest.raises(ValueError, match="survive"):
        execute.apply_with_backup(manifests.backup_plan(everything, files), str(tmp_path / "m"), confirm=True)
    with pytest.raises(ValueError, match="missing"):
        execute.apply_with_backup(manifests.backup_plan(marked, files.where(~F.col("path").endswith("/y"))), str(tmp_path / "m"), confirm=True)
    with pytest.raises(ValueError, match="surviving"):
        execute.apply_with_backup(manifests.backup_plan(marked, files.where(~F.col("path").endswith("/x"))), str(tmp_path / "m"), confirm=True)
    (tmp_path / "taken").write_bytes(b"not a folder")
    with pytest.raises(Exception):
        execute.apply_with_backup(manifests.backup_plan(marked, files), str(tmp_path / "taken/m"), confirm=True)
    assert sorted(os.listdir(tmp_path / "d")) == ["a", "b", "x", "y"] and not (tmp_path / "m").exists()


def test_links_are_carried_out(spark, tmp_path):
    make(tmp_path / "d", {"a": b"same", "b": b"same", "c": b"same"})
    found = groups.content_groups(scanned(spark, tmp_path / "d"))
    outcomes = execute.apply_plan(groups.keep_plan(found, 1, "link", target=str(tmp_path / "d/b")), confirm=True)
    assert execute.sentence("link", outcomes) == "2 files turned into a link"
    assert [os.path.islink(tmp_path / "d" / n) for n in "abc"] == [True, False, True] and os.readlink(tmp_path / "d/a") == str(tmp_path / "d/b")
    assert execute.sentence("reflink", [("x", "reflink", "error: no"), ("y", "reflink", "done")]) == "1 file turned into a clone, 1 file left as before after errors"
    assert execute.sentence("delete", [("x", "delete", "error: no")]) == "0 files removed, 1 file left as before after errors" and execute.sentence("link", []) == "Nothing to do: no file was turned into a link"


def test_near_content_counters_and_cap(spark):
    files = files_of(spark, [(f"/{k}", bytes([65 + k]) * 50) for k in range(5)] + [("", b"x" * 50), ("/e", b""), ("/s", b"x")])
    config = FuzzyConfig(max_candidates=3, min_size=10)
    assert fuzzy.fuzzy_metrics(files, config).first().asDict() == {"scanned": 8, "too_small": 1, "skipped": 2, "processed": 3, "truncated": 2}
    assert [r.path for r in fuzzy.signatures(files, config).orderBy("path").collect()] == ["/0", "/1", "/2"]


def test_same_extension_and_least_size_of_near_content(spark):
    text = b"alpha beta gamma delta " * 20
    files = files_of(spark, [("/a.txt", text), ("/b.TXT", text + b"x"), ("/c.md", text), ("/d.txt", text[:90])])
    config = FuzzyConfig(threshold=85, min_size=100, same_extension=True)
    assert {r.path for r in fuzzy.fuzzy_members(files, config).collect()} == {"/a.txt", "/b.TXT"}


def test_virtual_folders_and_devices(spark):
    rows = [("/proc/a", 1, 1), ("/r/b", 1, 1), ("/r/c", 2, 1), ("/run", 1, 1)]
    files = spark.createDataFrame([(p, 5, d, r) for p, d, r in rows], "path string, size long, dev long, root_dev long")
    got = lambda config: sorted(r.path for r in filters.apply_filters(files, config).collect())
    assert got(ScanConfig()) == ["/r/b", "/r/c"] and got(ScanConfig(virtual=True)) == ["/proc/a", "/r/b", "/r/c", "/run"]
    assert got(ScanConfig(one_file_system=True)) == ["/r/b"]


def test_reports_in_parts_and_lines(spark, tmp_path):
    found = groups.content_groups(files_of(spark, [("/a", b"1"), ("/b", b"1"), ("/c", b"2"), ("/d", b"2")]))
    sinks.write_csv_parts(found, str(tmp_path / "parts"))
    back = spark.read.option("header", True).csv(str(tmp_path / "parts"))
    assert back.columns == groups.LONG and back.count() == 4
    assert sinks.summary_line(groups.stage_metrics(files_of(spark, [("/a", b"1"), ("/b", b"1")])).first().asDict(), 1.5) == "content run, scanned 2, sampled 2, fully hashed 0, skipped by size 0, skipped by sample 0; done after 1.50 s"
    assert sinks.summary_line({"scanned": 3, "processed": 2, "skipped": 1}, 0, "fuzzy") == "fuzzy run, scanned 3, processed 2, skipped 1; done after 0.00 s"
    assert list(sinks.text_lines(found, bullets=True))[1:3] == ["  - /a", "  - /b"] or list(sinks.text_lines(found, bullets=True))[1:3] == ["  - /c", "  - /d"]


def test_overlapping_roots_count_a_file_once(spark, tmp_path):
    make(tmp_path, {"a": b"1", "d/b": b"1"})
    seen = tree.scan(spark, [str(tmp_path), str(tmp_path / "d")])
    assert seen.where(F.col("path").endswith("/b")).count() == 2
    assert sorted(os.path.basename(r.path) for r in filters.apply_filters(seen, ScanConfig()).collect()) == ["a", "b"]


def test_same_as_hashes_only_what_agrees(spark):
    big = b"x" * 5000
    files = files_of(spark, [("/t", big + b"1"), ("/u", big + b"1"), ("/v", big + b"2"), ("/w", b"1")])
    assert [(r.path, r.is_target) for r in groups.same_as(files, "/t").collect()] == [("/t", True), ("/u", False)]
    assert groups.same_as(files, "/none").count() == 0
    outside = files_of(spark, [("/o", big + b"2")])
    assert [(r.path, r.is_target) for r in groups.same_as(files, "/o", target=outside).collect()] == [("/o", True), ("/v", False)]


def test_two_components_with_one_key(spark):
    """Representatives of one signature that are too far apart in size: two components, one group."""
    one, two = b"abcd" * 30, b"abcd" * 90
    files = files_of(spark, [("/a", one), ("/b", one), ("/x", two), ("/y", two)])
    found = fuzzy.fuzzy_groups(files, FuzzyConfig(min_size=0, threshold=100)).collect()
    assert {(r.path, r.component, r.duplicate_count) for r in found} == {("/a", "/a", 4), ("/b", "/a", 4), ("/x", "/x", 4), ("/y", "/x", 4)}
    assert len({r.hash for r in found}) == 1


def test_walk_in_rounds_and_links_in_place_of_folders(spark, tmp_path):
    names = {f"d{k % 5}/e{k % 3}/f{k}": bytes([k]) for k in range(30)} | {"top": b"t", "d0/.h/x": b"h"}
    make(tmp_path / "r", names)
    found = tree.scan(spark, [str(tmp_path / "r"), str(tmp_path / "r/top"), str(tmp_path / "none"), str(tmp_path / "r")], most=2)
    assert sorted(r.path for r in found.collect()) == sorted(str(tmp_path / "r" / n) for n in names)
    assert tree.scan(spark, [str(tmp_path / "r")], hidden=False).count() == 31 and tree.scan(spark, [str(tmp_path / "r")], 0).count() == 1
    (tmp_path / "other").mkdir()
    (tmp_path / "other/f0").write_bytes(b"not this one")
    import shutil

    shutil.rmtree(tmp_path / "r/d0/e0")
    os.symlink(tmp_path / "other", tmp_path / "r/d0/e0")
    content = {r.path: r.content for r in tree.with_content(found).collect()}
    assert content[str(tmp_path / "r/d0/e0/f0")] is None and bytes(content[str(tmp_path / "r/top")]) == b"t"


def test_file_system_of_the_nearest_mount(tmp_path):
    table = tmp_path / "mounts"
    table.write_text(f"1 0 8:1 / / rw - ext4 /dev/a rw\n2 1 8:2 / {tmp_path} rw shared:1 - xfs /dev/b rw\n3 1 8:3 / {tmp_path}x rw - btrfs /dev/c rw\n")
    assert [tree.file_system(str(p), str(table)) for p in (tmp_path, tmp_path / "below", "/")] == ["xfs", "xfs", "ext4"]
    assert tree.file_system("/", str(tmp_path / "none")) == "unknown"


def test_a_clone_that_cannot_be_made_leaves_the_file(spark, tmp_path):
    make(tmp_path / "d", {"a": b"same", "b": b"same"})
    found = groups.content_groups(scanned(spark, tmp_path / "d"))
    (outcome,) = execute.apply_plan(groups.keep_plan(found, 1, "reflink"), confirm=True)
    assert outcome[2] == "done" or outcome[2].startswith("error")
    assert (tmp_path / "d/b").read_bytes() == b"same" and sorted(os.listdir(tmp_path / "d")) == ["a", "b"]
