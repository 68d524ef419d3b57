"""Files read in pieces: digests, samples and signatures against those of whole contents, and groups of large trees."""

import hashlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from twinlake.functions import blake3
from twinlake.functions.simhash import Simhash, signature
from twinlake.operators import groups
from twinlake.sources import content, tree

#: From the published test vectors: bytes k % 251, of these lengths.
VECTORS = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"}


def test_running_blake3_at_the_borders_of_chunks_and_pieces(monkeypatch):
    for n, want in VECTORS.items():
        state = blake3.Blake3()
        state.update(bytes(k % 251 for k in range(n)))
        assert state.hexdigest() == want
    data = bytes(k * k % 251 for k in range(41_000))
    for piece in (1024, 4096):
        monkeypatch.setattr(blake3, "PIECE", piece)
        for n in [0, 1, 1023, 1024, 1025, 4095, 4096, 4097, 8192, 8193, 12_288, 16_384, 16_385, 20_480, 40_960, 41_000]:
            for step in (700, 1024, 50_000):
                state = blake3.Blake3()
                for a in range(0, n, step):
                    state.update(data[a : min(n, a + step)])
                assert state.hexdigest() == blake3.blake3(data[:n]).hex(), (piece, n, step)


def test_running_simhash(monkeypatch):
    data = os.urandom(5000)
    for n in (0, 1, 2, 3, 4, 5, 999, 5000):
        for step in (1, 3, 700, 9000):
            state = Simhash()
            for a in range(0, n, step):
                state.update(data[a : min(n, a + step)])
            assert state.value() == signature(data[:n]), (n, step)


def test_facts_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(content, "READ", 1000)
    rows = {"empty": b"", "short": b"abc", "long": os.urandom(300_000), "edge": b"x" * 4096}
    for name, data in rows.items():
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "long", tmp_path / "link")
    files = tree.scan(spark, [str(tmp_path)])
    missing = files.limit(1).withColumn("path", F.lit(str(tmp_path / "link"))).unionByName(files.limit(1).withColumn("path", F.lit(str(tmp_path / "none"))))
    for algorithm in ("sha256", "blake3"):
        got = {os.path.basename(r.path): r for r in content.with_facts(files.unionByName(missing), ("hash", "sample", "sig", "bytes_read"), algorithm).collect()}
        for name, data in rows.items():
            whole = hashlib.sha256(data).hexdigest() if algorithm == "sha256" else blake3.blake3(data).hex()
            assert (got[name].hash, got[name].sample, got[name].sig, got[name].bytes_read) == (whole, hashlib.sha256(data[:4096]).hexdigest(), signature(data[: 256 * 1024]), len(data))
        assert got["link"].hash is got["none"].sample is got["none"].sig is None
    few = {os.path.basename(r.path): r for r in content.with_facts(files, ("sample", "sig", "bytes_read"), read_limit=100).collect()}
    assert few["long"].bytes_read == 4096 and few["long"].sig == signature(rows["long"][:100])
    limit = {os.path.basename(r.path): r.sig for r in content.with_facts(files, ("sig",)).collect()}
    assert limit["long"] == signature(rows["long"][: 256 * 1024])  # the default limit of signatures
    with pytest.raises(ValueError):
        content.with_facts(files, ("colour",))


def test_ranges_of_one_file_are_hashed_by_several_tasks(spark, tmp_path):
    size = 9 * blake3.PIECE + 12_345
    data = os.urandom(size)
    (tmp_path / "large").write_bytes(data)
    files = tree.scan(spark, [str(tmp_path)])
    for width in (1, 2, 8):
        got = content.blake3_by_ranges(files, width * blake3.PIECE).first()
        assert got.hash == blake3.blake3(data).hex()
    assert content.blake3_by_ranges(files.withColumn("size", F.lit(size + 5)), blake3.PIECE).first().hash is None
    assert content.blake3_by_ranges(files).count() == 0  # not over one range
    with pytest.raises(ValueError):
        content.blake3_by_ranges(files, 3 * blake3.PIECE)


def test_groups_of_a_tree_by_stages(spark, tmp_path):
    big = os.urandom(5000)
    rows = {"a": big + b"1", "b/b": big + b"1", "c": big + b"2", "d": b"tiny", "b/e": b"tiny", "f": b"lone!!", "g": os.urandom(5001)}
    for name, data in rows.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = tree.scan(spark, [str(tmp_path)])
    want = {tuple(r) for r in groups.content_groups(tree.with_content(files)).collect()}
    for algorithm in ("sha256", "blake3"):
        run = groups.staged_tree(files, algorithm=algorithm)
        got = {tuple(r) for r in run.groups.collect()}
        assert got == (want if algorithm == "sha256" else {tuple(r) for r in groups.content_groups(tree.with_content(files), algorithm="blake3").collect()})
        assert run.metrics.first().asDict() == {"scanned": 7, "sampled": 6, "fully_hashed": 3, "skipped_by_size": 1, "skipped_by_sample": 1}
    assert groups.staged_tree(files.limit(0)).metrics.first().asDict() == {"scanned": 0, "sampled": 0, "fully_hashed": 0, "skipped_by_size": 0, "skipped_by_sample": 0}


def sparse(path, size, tail=b""):
    with open(path, "wb") as f:
        f.truncate(size)
        if tail:
            f.seek(size - len(tail))
            f.write(tail)


def test_many_large_files_and_one_over_two_gigabytes(spark, tmp_path):
    for k in range(230):
        sparse(tmp_path / f"{k:03}", 10 << 20, b"odd" if k % 100 == 7 else b"")
    for name in ("x", "y"):
        sparse(tmp_path / name, (2 << 30) + 4097)
    files = tree.scan(spark, [str(tmp_path)])
    sizes = {(r.duplicate_count, r.size_bytes) for r in groups.staged_tree(files).groups.collect()}
    assert sizes == {(227, 10 << 20), (3, 10 << 20), (2, (2 << 30) + 4097)}
    with pytest.raises(Exception, match="read it in pieces"):
        tree.with_content(files).count()


def test_a_worker_holds_a_piece_of_a_large_file(tmp_path):
    sparse(tmp_path / "x", 1 << 30)
    code = f"import resource; from twinlake.sources.content import facts_of; print(facts_of(None, {str(tmp_path / 'x')!r}, ('hash', 'sample'))['hash'], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(__file__))).stdout.split()
    zeros = hashlib.sha256()
    for _ in range(1024):
        zeros.update(bytes(1 << 20))
    assert out[0] == zeros.hexdigest() and int(out[1]) < 500_000


def test_staged_counters_come_from_the_stages(spark):
    rows = [("/a", b"1"), ("/b", b"1"), ("/c", b"22"), ("/d", b"x" * 5000 + b"1"), ("/e", b"x" * 5000 + b"2")]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, size long, content binary")
    run = groups.staged_content(files)
    assert run.groups.count() == 2
    assert "FileScan" not in run.metrics._jdf.queryExecution().optimizedPlan().toString() and "content" not in run.metrics._jdf.queryExecution().optimizedPlan().toString()
    assert run.metrics.first().asDict() == {"scanned": 5, "sampled": 4, "fully_hashed": 2, "skipped_by_size": 1, "skipped_by_sample": 0}
