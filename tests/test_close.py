"""Components of signatures that differ in few bits."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlake.functions.simhash import max_distance
from twinlake.operators import close, fuzzy
from twinlake.plans.config import FuzzyConfig


def components(rows, distance, ratio=2):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (p, n, e, x), (q, m, f, y) in itertools.combinations(rows, 2):
        if e == f and (x ^ y).bit_count() <= distance and (max(n, m) <= ratio * min(n, m) if min(n, m) else n == m):
            a, b = sorted((root(p), root(q)))
            parent[b] = a
    found = {p: root(p) for p in parent}
    sizes = list(found.values())
    return {p: c for p, c in found.items() if sizes.count(c) > 1}


@pytest.mark.parametrize("threshold", [94, 95, 97, 98, 100])
def test_sizes_of_a_signature_are_linked_in_chains(spark, threshold):
    rng, distance = np.random.default_rng(threshold), max_distance(threshold)
    sigs = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 12)]
    rows = []
    for k in range(420):  # few signatures of many sizes, some a bit apart
        sig = sigs[int(rng.integers(len(sigs)))] & (1 << 64) - 1
        for bit in rng.choice(64, int(rng.integers(distance + 2)), replace=False):
            sig ^= 1 << int(bit)
        rows.append((f"/{k:03}", int(rng.choice([0, 1, 2, 4, 5, 9, 19, 20, 41, 83, 200, 399, 801, 1700, 3400])), str(rng.integers(2)), sig - (1 << 64 if sig >> 63 else 0)))
    table = spark.createDataFrame(rows, "path string, size long, ext string, sig long")
    config = FuzzyConfig(threshold=threshold, max_candidates=-1, min_size=0)
    want = components([(p, n, e, x & (1 << 64) - 1) for p, n, e, x in rows], distance)
    assert {r.path: r.component for r in fuzzy.members_of_signed(table, config).collect()} == want


def test_signatures_alike_in_most_bits_do_not_all_meet(spark):
    sig = F.xxhash64("id").bitwiseAND(F.lit((1 << 24) - 1))  # 24 bits tell them apart, two bands of 16 are all one
    rows = spark.range(20_000).select(F.format_string("/%d", "id").alias("path"), F.lit(100).cast("long").alias("size"), F.lit("").alias("ext"), sig.alias("sig"))
    told = fuzzy.candidates(rows, FuzzyConfig(threshold=95, max_candidates=-1, min_size=0)).first()
    assert told.pairs_met < told.all_pairs / 50 and told.copies == 20 * told.nodes


@pytest.mark.parametrize("rows, small, square, pairs, crowd", [(16, 2, 8, 4, 1 << 14), (1 << 18, 32, 1 << 18, 1 << 19, 40), (1, 1, 1, 1, 5)])
def test_units_and_crowds_of_any_size_lose_no_pair(monkeypatch, rows, small, square, pairs, crowd):
    for name, n in dict(ROWS=rows, SMALL=small, SQUARE=square, PAIRS=pairs).items():
        monkeypatch.setattr(close, name, n)
    rng, n = np.random.default_rng(3), 300
    sig = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64) & np.uint64(0x0101_0303_0101_0707) | np.uint64(1 << 63))
    blocks = close.Blocks([int((sig >> np.uint64(k) & np.uint64(1)).sum()) for k in range(64)], len(sig), 3)
    assert sorted(blocks.order) == list(range(64)) and len(blocks.last) == 20
    placed, ids = blocks.reordered(sig), np.arange(len(sig))
    parts = []
    for mask in blocks.last:
        by = np.argsort(placed & np.uint64(mask & (1 << 64) - 1))
        same = np.full(len(sig), 100)
        parts.append(pa.RecordBatch.from_pydict({"id": ids[by], "component": ids[by], "ext": pa.array([""] * len(sig)), "sig": placed[by].view(np.int64), "lo": same, "hi": same, "mask": np.full(len(sig), mask)}))
    found = pa.Table.from_batches(list(close._ties(iter([p.slice(k, 7) for p in parts for k in range(0, len(sig), 7)]), blocks, 2.0, crowd)))
    names = [f"/{k:03}" for k in ids]
    want = components([(p, 100, "", int(x)) for p, x in zip(names, sig)], 3)
    got = {names[a]: names[b] for a, b in zip(found["src"].to_pylist(), found["dst"].to_pylist())}
    assert got == {p: c for p, c in want.items() if p != c} and got
