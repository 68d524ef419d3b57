"""URL filters, hard negatives and vector codes against their SQL, brute force and difficult rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from twinlake.llm import hard_negatives, queries, url_filter, vector_codes

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_hard_negatives", "op13_vector_codes"])
def test_query_is_its_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SMALL), duck.execute(queries.ORACLES[name]))


URLS = [
    None, "", "example.org/en/1", "http://Example.ORG/en/17?x#y", "http://a.b.example.org/es/", "http://notexample.org/es/x", "http://example.org", "http://example.org?q=/es/",
    "https://x.com/fr/://y.org/", "://", "://org/", "http://a.com/de", "http://a.com/de/\nx", "HTTP://ÄB.org/É", "http://" + "a." * 50_000 + "org/" + "x/" * 50_000,
    "http://www.casino.net/a//b/?utm_source=x&k=1#top", "https://casino.net:443/a/b?k=1", "http://casino.net/a/b?k=2", "http://casino.net/a/b?k=2", "http://user@bets.com/fr/z",
]


def expected_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end : min([rest.find(c, end) for c in "?#" if c in rest[end:]] or [len(rest)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def test_rules_by_brute_force_and_lists(spark):
    rows = [(k if k != 3 else None, u, "block", "x") for k, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, host string")
    rules = [*url_filter.QUERY_RULES, ("example.org", "/en/17", "allow"), ("com", "/de/\n", "allow")]
    given = spark.createDataFrame([*rules, ("org", "/", "allow"), (None, "/", "block"), ("net", None, "block")], url_filter.RULES)
    listed = spark.createDataFrame([("casino.net/a/b?k=1",), ("bets.com/fr/z",), (None,), ("casino.net/a/b?k=1",)], "url string")
    got = url_filter.judge_urls(pages, given, listed).collect()
    assert len(got) == len(URLS)
    by_id = {r.page_id: r for r in got}
    for k, u in enumerate(URLS):
        r = by_id[k if k != 3 else None]
        host, path, rule, verdict = expected_rule(u, rules)
        assert (r.host, r.path, r.rule) == (host, path, rule), u and u[:80]
        assert r.verdict == (verdict or ("block" if k in (15, 16) else "allow")), u and u[:80]
    assert url_filter.judge_urls(pages.limit(0), given, listed).count() == 0
    none = url_filter.judge_urls(pages, given.limit(0), listed.limit(0))
    assert none.where("rule is null and verdict = 'allow'").count() == len(URLS)


def test_canonical_urls(spark):
    cases = {"http://www.A.com:80/x//y/?utm_source=a&b=1&ref=c#z": "a.com/x/y?b=1", "https://a.com": "a.com", "x": None, "://": None, "http://u:p@m.a.com/?ref=1": "a.com", "http://a.com/?preref=1": "a.com?preref=1"}
    rows = spark.createDataFrame(list(cases.items()), "url string, want string")
    for r in rows.select("url", "want", url_filter.canonical_url(F.col("url")).alias("got")).collect():
        assert r.got == r.want, r.url


def mined(rows, step, positives, negatives):
    """Brute force over ``(id, label, ints)``."""
    out = []
    for a, la, va in rows:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), b, label) for b, label, v in rows)
        for s, p, _ in [x for x in scored if x[2] == la and x[1] != a][:positives]:
            found = [(b, -t) for t, b, label in scored if label != la and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, k + 1, b, -s, t) for k, (b, t) in enumerate(found)]
    return sorted(out)


def test_mining_by_brute_force_with_ties_and_hot_vectors(spark):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        v = [rng.uniform(-1, 1) for _ in range(6)] if k % 3 else [0.5, 0.5, 0.25, 0.0, 0.0, 0.1]  # a third are one vector
        rows.append((k * 5 - 2000, rng.choice([0, 0, 0, 1, 2]), v))
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    ints = [(k, label, [math.floor(256 * float(np.float32(x))) for x in v]) for k, label, v in rows]
    for gather in (32, 1):
        hard_negatives.GATHER, before = gather, hard_negatives.GATHER
        try:
            got = hard_negatives.mine(frame, F.col("vec_id") % 50 == 0)
            assert sorted(map(tuple, got.collect())) == mined(ints, 50, 5, 3)
        finally:
            hard_negatives.GATHER = before


def test_blocks_of_rows_and_anchors_change_nothing(spark, monkeypatch):
    want = sorted(map(tuple, queries.op12_hard_negatives(spark, SMALL).collect()))
    for name, value in (("PACK", 60), ("ANCHORS", 3), ("STEP", 4), ("BLOCKS_A_TASK", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, SMALL).collect())) == want


BAD = [(9, None, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (10, 1, None), (11, 1, [1.0, None]), (12, 1, [float("nan"), 1.0]), (13, 1, [1.0, float("inf")])]
GOOD = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.7, 0.5]), (3, 2, [0.7]), (4, 2, []), (50, 2, [0.5, 0.5])]


def test_rows_that_take_no_part_in_mining(spark):
    schema = "vec_id long, label int, embedding array<double>, score double, anchor_id string"
    frame = spark.createDataFrame([(*r, 1.0, "x") for r in [*GOOD, *BAD]], schema)
    got = sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") % 50 == 0).collect()))
    ints = {k: (k, label, [math.floor(256 * x) for x in v] + [0] * (2 - len(v))) for k, label, v in GOOD}
    assert got == mined(sorted(ints.values()), 50, 5, 3) and got
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(frame, F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>"), F.lit(True))


def test_negative_scores_and_empty_windows(spark):
    rows = [(0, 1, [-1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [-0.6]), (4, 3, [0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    ints = [(k, label, [math.floor(256 * x) for x in v]) for k, label, v in rows]
    assert sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") >= 0).collect())) == mined(ints, 1, 5, 3)


def test_partial_distances_find_the_nearest_entry():
    rng = np.random.default_rng(3)
    for n, m, width, span in ((500, 16, 8, 40), (300, 16, 8, 2), (50, 1, 3, 9), (64, 5, 1, 3)):
        x, book = rng.integers(-span, span + 1, (n, width)), rng.integers(-span, span + 1, (m, width))
        book[-1] = book[0]  # ties go to the lower index
        index, best = vector_codes.nearest(x, book)
        distance = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def coded(rows, parts=8, entries=16, rounds=6):
    """Brute force over ``(id, label, floats)`` that take part."""
    width = max(1, -(-max(len(v) for _, _, v in rows) // parts))
    data = [(k, label, [math.floor(4096 * x) for x in v] + [0] * (parts * width - len(v))) for k, label, v in rows]
    first = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def near(p, v):
        x = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[near(p, r[2])[1] for r in data] for p in range(parts)]
        for p in range(parts):
            for e in range(len(first)):
                own = [r[2][p * width : (p + 1) * width] for r, k in zip(data, at[p]) if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [(k, label, [near(p, v) for p in range(parts)]) for k, label, v in data]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = lambda x: sum(d for d, _ in x)
    return [(k, "".join(f"{e:02x}" for _, e in x), error(x), sum(error(y) for _, other, y in found if other == label), digest) for k, label, x in found]


def test_codes_by_brute_force_on_hard_rows(spark):
    rng = random.Random(2)
    rows = [(k if k % 17 else None, rng.choice([1, 1, None, 3]), [rng.uniform(-1, 1) for _ in range(rng.choice([19, 20]))]) for k in range(150)] + [(7, 2, [0.5] * 20)] * 60 + [(8, 2, [])]
    bad = [(1, 1, None), (2, 1, [1.0, None]), (3, 1, [float("nan")]), (4, 1, [float("-inf")])]
    frame = spark.createDataFrame([(*r, "x", 2) for r in rows + bad], "vec_id long, label int, embedding array<double>, code string, error int")
    key = lambda r: repr(r)
    assert sorted(map(tuple, vector_codes.encode(frame).collect()), key=key) == sorted(coded(rows), key=key)
    assert sorted(map(tuple, vector_codes.encode(frame.where("vec_id in (8, 10, 11)")).collect()), key=key) == sorted(coded([r for r in rows if r[0] in (8, 10, 11)]), key=key)
    assert vector_codes.encode(frame.limit(0)).count() == 0 and vector_codes.encode(frame.where("vec_id = 4 and label = 9")).count() == 0
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>"))
