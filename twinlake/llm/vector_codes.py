"""Vectors as codes of their parts: codebooks of integer vectors, learned and searched in exact integer arithmetic.

The nearest entry is found by partial distances: dimensions go in descending variance over the codebook, and an entry is
dropped for a vector once what has been summed exceeds the distance of the best entry that is complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.llm.wordtable import give_back
from twinlake.session import bound_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are searched at once.
STEP = 1 << 15
OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of ``book`` that is nearest to each row of ``x`` by squared distance, ties to the lower index, and that
    distance.

    Dimensions go in descending variance over the codebook. The entry that is nearest in the first of them is completed
    first, so most others are dropped early; what equals the best stays, as it may have the lower index.
    """
    n, m = len(x), len(book)
    spread = m * (book.astype(object) ** 2).sum(axis=0) - book.astype(object).sum(axis=0) ** 2
    order = sorted(range(x.shape[1]), key=lambda d: -spread[d])
    cols = [np.ascontiguousarray(x[:, d]) for d in order]
    book = book[:, order]
    ranked = np.argsort(book[:, 0], kind="stable")
    sorted_first = book[ranked, 0]
    near = np.clip(np.searchsorted(sorted_first, cols[0]), 0, m - 1)
    below = np.maximum(near - 1, 0)
    near = np.where(np.abs(sorted_first[below] - cols[0]) <= np.abs(sorted_first[near] - cols[0]), below, near)
    first = ranked[near]
    index = first.copy()
    best = np.zeros(n, np.int64)
    for d, col in enumerate(cols):
        best += (col - book[first, d]) ** 2
    for e in range(m):
        some = np.flatnonzero(first != e)
        total = np.zeros(len(some), np.int64)
        for d, col in enumerate(cols):
            total += (col[some] - book[e, d]) ** 2
            alive = total <= best[some]
            if not alive.all():
                some, total = some[alive], total[alive]
        nearer = (total < best[some]) | (e < index[some])
        some = some[nearer]
        best[some], index[some] = total[nearer], e
    return index, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The integer vectors of a batch, whose bytes stand one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]].view(np.int32).reshape(len(column), dim).astype(np.int64) if len(column) else np.zeros((0, dim), np.int64)


def _assigned(column: pa.Array, books: np.ndarray, dim: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For some rows at once: the first row's number, the vectors by part, and the entries and distances by part."""
    parts, _, width = books.shape
    for a in range(0, len(column), STEP):
        x = _matrix(column.slice(a, STEP), dim).reshape(-1, parts, width)
        yield a, x, [nearest(x[:, p], books[p]) for p in range(parts)]


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """``(part, entry, place, n, total)``: what a task's rows add to the entries; one row a component, at most."""
    parts, entries, width = books.shape
    count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for batch in batches:
        for _, x, found in _assigned(batch.column("vector"), books, dim):
            for p, (index, _) in enumerate(found):
                count[p] += np.bincount(index, minlength=entries)
                order = np.argsort(index, kind="stable")
                heads = np.flatnonzero(np.append(True, index[order][1:] != index[order][:-1]))
                total[p, index[order][heads]] += np.add.reduceat(x[order, p], heads, axis=0)
    p, e, d = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)) for k in (p, e, d)] + [pa.array(count[p, e]), pa.array(total[p, e, d])], names=["part", "entry", "place", "n", "total"])
    give_back()


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    hexes = np.array([f"{k:02x}" for k in range(books.shape[1])])
    for batch in batches:
        for a, x, found in _assigned(batch.column("vector"), books, dim):
            text = hexes[found[0][0]]
            for index, _ in found[1:]:
                text = np.char.add(text, hexes[index])
            error = sum(distance for _, distance in found)
            same = [batch.column(c).slice(a, len(x)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(text.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
    give_back()


def learn(vectors: DataFrame, seeds: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(part, entry, place)`` after so many rounds from ``seeds``. A round is one pass over the vectors;
    tasks send sums and counts of entries, and the driver sees one sum a component."""
    books, dim = seeds.copy(), seeds.shape[0] * seeds.shape[2]
    for _ in range(rounds):
        now = books
        found = vectors.select("vector").mapInArrow(lambda b: _sums(b, now, dim), "part int, entry int, place int, n long, total long")
        sums = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = books.copy()
        for r in sums.collect():
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    return books


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``, one row per row of ``rows`` that takes part.

    Components become ``floor(4096 * x)``; vectors are cut into equal consecutive parts, each with a codebook that
    starts as that part of the rows with the smallest ids. Each round assigns all parts to their nearest entry (ties
    to the lower index) and moves each entry to the floor of its parts' mean; an entry without parts stays.
    ``error`` is the sum of squared distances, ``label_error`` their sum over the rows of a label, nulls together.

    Rows with a null vector or component, or one that is not finite, take no part. Null ids come after all others
    where seeds are chosen; rows that share an id are rows of their own, ordered by their vectors. Fewer rows than
    entries make shorter codebooks. Vectors of different lengths, or that cannot be cut equally, are as if filled up
    with zeros. No rows give no rows. Components so large that distances leave 64 bits are an error. Other columns
    are not read.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))
    kept = rows.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("vector"))
    largest = F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v).cast("double"))))
    facts = kept.agg(F.max(F.size("vector")).alias("dim"), largest.alias("c")).first()
    if facts["dim"] is None:
        return spark.createDataFrame([], OUT)
    width = max(1, -(-facts["dim"] // parts))
    dim = width * parts
    if dim * (2 * int(facts["c"])) ** 2 >= 2**63:
        raise ValueError("components are too large: distances would not fit 64 bits")
    label = kept.schema["label"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            codes = np.zeros((len(column), dim), np.int32)
            codes[np.arange(dim) < sizes[:, None]] = flat
            data = pa.py_buffer(codes.tobytes())
            offsets = pa.py_buffer((np.arange(len(column) + 1) * 4 * dim).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.Array.from_buffers(pa.binary(), len(column), [None, offsets, data])], names=["vec_id", "label", "vector"])
        give_back()

    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    seeds = np.zeros((len(first), dim), np.int64)
    for k, r in enumerate(first):
        seeds[k, : len(r.vector)] = r.vector
    vectors = cut(kept.mapInArrow(packed, f"vec_id long, label {label}, vector binary"))
    books = learn(vectors, seeds.reshape(len(first), parts, width).transpose(1, 0, 2), rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = cut(vectors.mapInArrow(lambda b: _codes(b, books, dim), f"vec_id long, label {label}, code string, error long"))
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dim: int = 64) -> str:
    width = dim // parts
    out = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[{width} * part + 1 : {width} * part + {width}] AS x FROM k, range({parts}) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})),"""
    near = "SELECT vec_id, label, p.part, x, d.entry, d.dist FROM (SELECT vec_id, label, part, x, min(struct_pack(dist := list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y), entry := entry)) AS d FROM p JOIN {c} USING (part) GROUP BY ALL) p"
    for r in range(rounds):
        out += f"""
a{r} AS MATERIALIZED ({near.format(c=f"c{r}")}),
m{r} AS (SELECT part, entry, place, floor(sum(x[place]) / count(*)) AS z FROM a{r}, range(1, {width + 1}) t(place) GROUP BY ALL),
n{r} AS (SELECT part, entry, list(z ORDER BY place) AS y FROM m{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.y, c.y) AS y FROM c{r} c LEFT JOIN n{r} n ON n.part = c.part AND n.entry = c.entry),"""
    return out + f"""
a AS ({near.format(c=f"c{rounds}")}),
f AS (SELECT vec_id, label, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda z: z::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, s
"""
