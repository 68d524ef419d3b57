import pytest
from pyspark.sql import functions as F

from twinlake.functions import digests, paths, simhash, sizes
from twinlake.functions.blake3 import blake3, blake3_many
from twinlake.operators import groups
from twinlake.plans.config import FuzzyConfig, ScanConfig, check_modes, looks_at_hidden


def test_blake3_published_vectors():
    data = bytes(k % 251 for k in range(2049))
    known = {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    }
    assert {n: blake3(data[:n]).hex() for n in known} == known
    assert blake3_many([data, b"", data[:7]]) == [blake3(data), blake3(b""), blake3(data[:7])]


@pytest.mark.parametrize("text, size", [("1K", 1000), ("1KiB", 1024), ("1.5G", 1_500_000_000), ("2Gi", 2147483648), ("1e3", 1000), ("2 GiB", 2147483648), ("0", 0), ("1_000", 1000), ("1tibibyte", 1 << 40), ("2 tebibytes", 2 << 40), ("1mebibyte", 1 << 20), ("1mibibytes", 1 << 20), ("1pibi", 1 << 50), ("1EiBi", 1 << 60), ("1exbibyte", 1 << 60)])
def test_parse_size(text, size):
    assert sizes.parse_size(text) == size


@pytest.mark.parametrize("text", ["", "abc", "-1", "1XB", "nan", "inf"])
def test_parse_size_refuses(text):
    with pytest.raises(ValueError):
        sizes.parse_size(text)


def test_display_size(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1152,), (200034,), (1 << 60,)], "n long")
    assert [r[0] for r in rows.select(sizes.display_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.12 KiB", "195.35 KiB", "1.00 EiB"]


def test_paths(spark):
    rows = spark.createDataFrame([("/a/b.TXT",), ("/a/",), ("",), ("//",), ("/x/.bashrc",)], "p string")
    out = rows.select(paths.base_name(F.col("p")).alias("n"), paths.extension(F.col("p")).alias("e")).collect()
    assert [(r.n, r.e) for r in out] == [("b.TXT", ".txt"), ("a", ""), (".", "."), ("/", ""), (".bashrc", ".bashrc")]


def brute_signature(content):
    tokens = [content[k : k + 4] for k in range(len(content) - 3)] if len(content) >= 4 else [content[k : k + 1] for k in range(len(content))]
    weights = [0] * 64
    for token in tokens:
        h = 14695981039346656037
        for b in token:
            h = (h ^ b) * 1099511628211 % 2**64
        for k in range(64):
            weights[k] += 1 if h >> k & 1 else -1
    return sum(1 << k for k in range(64) if weights[k] > 0)


@pytest.mark.parametrize("content", [b"a", b"abcd", b"\x00\xff\x12\x34", b"alpha beta gamma" * 40])
def test_signature(content):
    assert simhash.signature(content) % 2**64 == brute_signature(content)


def test_signature_of_nothing():
    assert simhash.signature(b"") is None


def test_distances(spark):
    assert [simhash.max_distance(t) for t in (100, 85, 0, 75)] == [0, 9, 64, 16]
    rows = spark.createDataFrame([(0,), (64,), (16,), (99,)], "d int").select(simhash.similarity(F.col("d")))
    assert [r[0] for r in rows.collect()] == [100, 0, 75, 0]


def test_config():
    assert (FuzzyConfig(threshold=0).threshold, FuzzyConfig(max_candidates=0).max_candidates, FuzzyConfig(max_ratio=0.5).max_ratio) == (75, 10_000, 2.0)
    assert ScanConfig.of("1K", current=True) == ScanConfig(min_size=1000, max_depth=0)
    for bad in ({"min_group": 1}, {"max_depth": -2}, {"min_size": 9, "max_size": 3}, {"algorithm": "md5"}):
        with pytest.raises(ValueError):
            ScanConfig(**bad)
    with pytest.raises(ValueError):
        check_modes(fuzzy=True, keep=True)
    with pytest.raises(ValueError):
        digests.parse_digest("12")


def test_hidden_targets_switch_hidden_files_on():
    assert [looks_at_hidden(), looks_at_hidden(True), looks_at_hidden(name=".x"), looks_at_hidden(single_file="/a/.x"), looks_at_hidden(single_file="/.a/x")] == [False, True, True, True, False]


def test_sort_modes():
    assert [groups.next_mode(m) for m in ("size", "count", "other")] == ["count", "size", "size"]


def test_titles(spark):
    rows = [("content", "k", "ab" * 32, 2, 2048), ("name", "n.txt", "cd" * 32, 3, 10), ("fuzzy", "sig", "ef" * 32, 2, 0), ("content", "k", "ab" * 32, 0, 0)]
    frame = spark.createDataFrame(rows, "match_type string, match_key string, hash string, duplicate_count long, total_bytes long")
    got = frame.select(groups.title_of(frame).alias("t"), groups.title_of(frame, True).alias("c")).collect()
    assert [r.t for r in got] == ["ab" * 16 + " - 2 files - (approx. size 2.00 KiB)", "Name: n.txt - 3 files - (approx. size 10 B)", "Similar: sig - 2 files - (approx. size 0 B)", "Empty group"]
    assert [r.c for r in got][:2] == ["ab" * 8 + " - 2 files - approx. 2.00 KiB", "Name: n.txt - 3 files - approx. 10 B"]


def test_signatures_of_many(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    monkeypatch.setattr(simhash, "ROWS", 3)
    texts = [b"a", None, b"", b"abc", b"abcd", b"alpha beta " * 30, b"x" * 49, b"yz" * 25, b"yz" * 26, b"\x00" * 3, b"gamma"]
    got = simhash.signatures_of(texts)
    assert [None if x is None else x % 2**64 for x in got] == [brute_signature(t) if t else None for t in texts]
