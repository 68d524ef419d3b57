"""Hard negatives by distributed radix selection on integer scores.

Rows are packed into blocks, anchors into blocks of their own; a task scores a block of rows against a block of anchors.
For each window (the rows that compete for an anchor's first places) the tasks send histograms of one digit of the score;
the digit that holds the k-th place is refined digit by digit, by score and among equal scores by id, until few rows are
left at it. Only rows down to that place are gathered, and ranked.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.llm.wordtable import give_back
from twinlake.session import bound_batches

SCALE = 256
#: Rows of a block, anchors of a block, windows that are looked at at once, bits of a digit.
PACK, ANCHORS, STEP, DIGIT = 8192, 4096, 64, 8
#: A window whose k-th place is known to so many rows is gathered.
GATHER = 32
#: Blocks of rows that meet one copy of a block of anchors in a task.
BLOCKS_A_TASK = 16
#: Largest bound of a score: percentages of it must fit 64 bits.
MOST_SCORE = 1 << 55

PACKED = "ids binary, labels binary, codes binary"
WINDOW = ["w", "anchor", "top", "bottom", "low_id", "high_id", "need"]


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part, components as integers; one row an id."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    kept = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("vector"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")


def packed(ids: pa.Array, labels: pa.Array, vectors: pa.Array, dim: int) -> tuple[bytes, bytes, bytes]:
    """Rows as three byte strings; shorter vectors are filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    codes = np.zeros((len(ids), dim), np.int64)
    codes[np.arange(dim) < sizes[:, None]] = flat
    return ids.to_numpy().tobytes(), labels.to_numpy().tobytes(), codes.astype(np.int32).tobytes()


def _pack_rows(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    held, count = [], 0

    def one() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        parts = packed(*(table.column(c).combine_chunks() for c in ("vec_id", "label", "vector")), dim)
        return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["ids", "labels", "codes"])

    for batch in batches:
        for a in range(0, batch.num_rows, PACK):
            part = batch.slice(a, PACK)
            if count + part.num_rows > PACK:
                yield one()
                held, count = [], 0
            held.append(part)
            count += part.num_rows
    if held:
        yield one()
    give_back()


def _arrays(row: dict, dim: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, codes = (row[prefix + c] for c in ("ids", "labels", "codes"))
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(codes, np.int32).reshape(-1, dim)


def _members(batches: Iterator[pa.RecordBatch], dim: int, bound: int, same: bool) -> Iterator[tuple]:
    """For some windows of a block of anchors and a block of rows: the block's number, the windows' columns, the rows'
    ids, the scores (window by row) and which rows are members: other rows of the anchor's label, or rows of others."""
    exact = np.float64 if bound < 1 << 53 else np.int64
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels, codes = _arrays(row, dim)
            a_ids, a_labels, a_codes = _arrays(row, dim, "a_")
            state = np.frombuffer(row["windows"], np.int64).reshape(-1, len(WINDOW))
            state = state[np.argsort(state[:, 1], kind="stable")]
            right = codes.T.astype(exact)
            for k in range(0, len(state), STEP):
                part = state[k : k + STEP]
                anchors, place = np.unique(part[:, 1], return_inverse=True)
                scores = (a_codes[anchors].astype(exact) @ right)[place]
                like = a_labels[part[:, 1], None] == labels
                member = like & (a_ids[part[:, 1], None] != ids) if same else ~like
                yield row["block"], dict(zip(WINDOW, part.T)), ids, scores, member


def _shift(width: np.ndarray) -> np.ndarray:
    """Bits below the first digit of numbers up to ``width``."""
    bits = np.array([int(x).bit_length() for x in width], np.int64)
    return np.maximum(bits - DIGIT, 0)


def _digits(w: dict, ids: np.ndarray, scores: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and digit, from the best, of each member in its window's range."""
    by_id = w["top"] == w["bottom"]
    at, rows = np.nonzero(member & (scores <= w["top"][:, None]) & (scores >= w["bottom"][:, None]))
    score, own = scores[at, rows].astype(np.int64), ids[rows]
    good = ~by_id[at] | (own >= w["low_id"][at]) & (own <= w["high_id"][at])
    at, score, own = at[good], score[good], own[good]
    of_score = (w["top"][at] - score) >> _shift(w["top"] - w["bottom"])[at]
    low, high = w["low_id"].astype(np.uint64), w["high_id"].astype(np.uint64)  # differences modulo 2^64 don't overflow
    of_id = ((own.astype(np.uint64) - low[at]) >> _shift(high - low).astype(np.uint64)[at]).astype(np.int64)
    return at, np.where(by_id[at], of_id, of_score)


def _histograms(batches: Iterator[pa.RecordBatch], dim: int, bound: int, same: bool) -> Iterator[pa.RecordBatch]:
    """``(block, w, digit, n)``. A block of rows that has as many members as a window needs sends no digits after
    that: those can't be reached."""
    for block, w, ids, scores, member in _members(batches, dim, bound, same):
        at, digit = _digits(w, ids, scores, member)
        n = np.bincount((at << DIGIT) + digit, minlength=len(scores) << DIGIT).reshape(-1, 1 << DIGIT)
        before = np.cumsum(n, axis=1) - n
        at, digit = np.nonzero((n > 0) & (before < w["need"][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int32)), pa.array(w["w"][at]), pa.array(digit.astype(np.int32)), pa.array(n[at, digit].astype(np.int64))], names=["block", "w", "digit", "n"])
    give_back()


def _refined(w: dict, digit: np.ndarray) -> np.ndarray:
    """The windows, each narrowed to one digit of its range."""
    w = {c: v.copy() for c, v in w.items()}
    by_id = w["top"] == w["bottom"]
    some = np.flatnonzero(~by_id)
    shift = _shift(w["top"][some] - w["bottom"][some])
    top = w["top"][some] - (digit[some] << shift)
    w["bottom"][some] = np.maximum(w["bottom"][some], top - (np.int64(1) << shift) + 1)
    w["top"][some] = top
    some = np.flatnonzero(by_id)
    low, high = (w[c][some].astype(np.uint64) for c in ("low_id", "high_id"))
    shift = _shift(high - low).astype(np.uint64)
    first = low + (digit[some].astype(np.uint64) << shift)
    w["high_id"][some] = np.minimum(w["high_id"][some], (first + (np.uint64(1) << shift) - np.uint64(1)).astype(np.int64))
    w["low_id"][some] = first.astype(np.int64)
    return np.stack([w[c] for c in WINDOW], axis=1)


def _gathered(batches: Iterator[pa.RecordBatch], dim: int, bound: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Members down to the end of each window's range; ``top`` and ``low_id`` are those that the range began with."""
    for block, w, ids, scores, member in _members(batches, dim, bound, same):
        col = {c: w[c][:, None] for c in WINDOW}
        good = member & (scores <= col["top"]) & ((scores > col["bottom"]) | (scores == col["bottom"]) & (ids <= col["high_id"]))
        at, rows = np.nonzero(good)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int32)), pa.array(w["w"][at]), pa.array(ids[rows]), pa.array(scores[at, rows].astype(np.int64))], names=["block", "w", "vec_id", "score"])
    give_back()


def _state(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in WINDOW], axis=1).astype(np.int64)


def first_places(packs: DataFrame, anchors: DataFrame, windows: DataFrame, dim: int, bound: int, same: bool, salts: int) -> DataFrame:
    """``(block, w, vec_id, score, rank)``: the first ``need`` members of each window ``(block, *WINDOW)``, highest score
    first, then smallest id; all, if fewer."""
    windows = cut(windows)
    whole, open_ = windows, windows.select("block", *WINDOW)

    def passes(state: DataFrame, f, schema: str) -> DataFrame:
        pack = lambda t: pa.table({"block": t.column("block").slice(0, 1), "windows": pa.array([_state(t).tobytes()], pa.binary())})
        sides = state.groupBy("block").applyInArrow(pack, "block int, windows binary").join(anchors, "block")
        sides = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return packs.join(sides, ["block", "salt"]).mapInArrow(functools.partial(f, dim=dim, bound=bound, same=same), schema)

    ended = None
    while True:
        found = passes(open_, _histograms, "block int, w long, digit int, n long").groupBy("block", "w", "digit").agg(F.sum("n").alias("n"))
        lists = found.groupBy("block", "w").agg(F.sort_array(F.collect_list(F.struct("digit", "n"))).alias("digits"))

        def narrow(table: pa.Table) -> pa.Table:
            state, digit, left = _state(table), [], []
            for need, digits in zip(state[:, WINDOW.index("need")].tolist(), table.column("digits").to_pylist()):
                k, before = 0, 0
                while k < len(digits) - 1 and before + digits[k]["n"] < need:
                    before += digits[k]["n"]
                    k += 1
                digit.append(digits[k]["digit"])
                left.append((before, digits[k]["n"]))
            before, here = np.array(left, np.int64).T
            fine = _refined(dict(zip(WINDOW, state.T)), np.array(digit, np.int64))
            fine[:, WINDOW.index("need")] -= before
            # few rows, all rows that there are, or a single row's place
            done = (here <= GATHER) | (here < fine[:, WINDOW.index("need")])
            out = {"block": table.column("block")} | {c: pa.array(fine[:, k]) for k, c in enumerate(WINDOW)}
            return pa.table(out | {"done": pa.array(done)})

        schema = "block int, " + ", ".join(f"{c} long" for c in WINDOW) + ", done boolean"
        # windows without any member are in no histogram and have no first places
        fine = cut(open_.join(lists, ["block", "w"]).groupBy("block").applyInArrow(narrow, schema))
        some = fine.where("done").drop("done")
        ended = some if ended is None else ended.unionByName(some)
        open_ = fine.where("not done").drop("done")
        if open_.isEmpty():
            break
    # down to the place that was found, from where the window began
    begin = whole.select("block", "w", F.col("top").alias("first_top"), F.col("need").alias("wanted"))
    ends = ended.join(begin, ["block", "w"]).withColumn("top", F.col("first_top"))
    rows = passes(ends.select("block", *WINDOW), _gathered, "block int, w long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("block", "w").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).join(begin.select("block", "w", "wanted"), ["block", "w"]).where("rank <= wanted").select("block", "w", "vec_id", "score", "rank")


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A score is the inner product of two rows' components, each ``floor(256 * x)``; higher ones come first, then smaller
    ids. Each row that ``is_anchor`` has as positives its first ``positives`` other rows of the same label, and for each
    of them the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's; all, if fewer. Labels are integers.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of rows that share an
    id, that with the smallest label and vector takes part. Vectors of different lengths are as if filled up with
    zeros; empty ones have scores of 0. No rows, or no anchors, give no rows. Components so large that scores leave
    64 bits are an error. Other columns are not read.

    Every row is scored against every anchor, in blocks of bounded size; copies of one vector, or a label that most
    rows have, make neither a block nor a histogram larger, and are told apart by digits of their ids. A window is
    gathered once at most ``GATHER`` rows share its last place.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    ids = rows.where(is_anchor).select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    kept = cut(usable(rows, id_col, label_col, vector_col))
    own = kept.join(ids, "vec_id")
    largest = F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v).cast("double"))))
    facts = kept.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), largest.alias("c"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).first()
    count = own.count()
    if not facts["n"] or not count:
        return spark.createDataFrame([], OUT)
    dim = max(1, facts["dim"])
    bound = dim * int(facts["c"]) ** 2 + 1
    if bound > MOST_SCORE or facts["c"] >= 2**31:
        raise ValueError("components are too large: scores would not fit 64 bits")
    blocks = math.ceil(count / ANCHORS)
    packings = max(1, math.ceil(facts["n"] / PACK))
    salts = min(packings, max(math.ceil(2 * spark.sparkContext.defaultParallelism / blocks), math.ceil(packings / BLOCKS_A_TASK)))

    def pack(table: pa.Table) -> pa.Table:
        parts = packed(*(table.column(c).combine_chunks() for c in ("vec_id", "label", "vector")), dim)
        return pa.table([table.column("block").slice(0, 1), *(pa.array([p], pa.binary()) for p in parts)], names=["block", "a_ids", "a_labels", "a_codes"])

    placed = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    anchors = cut(placed.groupBy("block").applyInArrow(pack, "block int, a_ids binary, a_labels binary, a_codes binary"))
    tasks = blocks * salts
    packs = kept.repartition(salts).mapInArrow(functools.partial(_pack_rows, dim=dim), PACKED).withColumn("salt", F.spark_partition_id())
    packs = cut(packs).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, "block", "salt")

    def per_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = np.frombuffer(row["a_ids"], np.int64)
                fixed = {"w": np.arange(len(a)), "anchor": np.arange(len(a)), "top": bound, "bottom": -bound, "low_id": facts["low"], "high_id": facts["high"], "need": positives}
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row["block"], np.int32)), *(pa.array(np.broadcast_to(np.asarray(fixed[c], np.int64), len(a))) for c in WINDOW), pa.array(a)], names=["block", *WINDOW, "anchor_id"])

    shape = "block int, " + ", ".join(f"{c} long" for c in WINDOW)
    one = cut(anchors.mapInArrow(per_anchor, shape + ", anchor_id long"))
    best = first_places(packs, anchors, one.select("block", *WINDOW), dim, bound, True, salts)
    pairs = best.join(one.select("block", "w", "anchor", "anchor_id"), ["block", "w"]).select(
        "block", (F.col("w") * positives + F.col("rank") - 1).alias("w"), "anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    pairs = cut(pairs)
    top, bottom = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100L)) div 100"), F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100L)) div 100)")
    spans = pairs.select("block", "w", "anchor", top.cast("long").alias("top"), bottom.cast("long").alias("bottom"), F.lit(facts["low"]).cast("long").alias("low_id"), F.lit(facts["high"]).cast("long").alias("high_id"), F.lit(negatives).cast("long").alias("need"))
    found = first_places(packs, anchors, spans.where("bottom <= top").select("block", *WINDOW), dim, bound, False, salts)
    return found.join(pairs, ["block", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
