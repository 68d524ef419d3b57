"""Digests, samples and signatures of files, read in pieces by the tasks: content is never a column, so neither the
number of files nor their sizes bound what can be grouped."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions.blake3 import PIECE, Blake3, merged, subtree
from twinlake.functions.digests import SAMPLE_BYTES, parse_algorithm
from twinlake.functions.simhash import READ_LIMIT, Simhash
from twinlake.session import bound_batches
from twinlake.sources.tree import open_below

#: Bytes that are read at once, and rows that are sent on at once.
READ, ROWS = 1 << 20, 256
KINDS = {"hash": "string", "sample": "string", "sig": "long", "bytes_read": "long"}
#: Bytes of a large file that one task hashes: a power of two of pieces, so a range is a subtree of its own.
RANGE = 64 << 20


def pieces(root: str | None, path: str, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
    """A file's bytes in order, ``READ`` at most at once. What is appended while it is read is read too, if there is
    no ``end``."""
    with open(open_below(root or os.path.dirname(path), path), "rb", buffering=0) as f:
        f.seek(begin)
        left = end - begin if end is not None else -1
        while left:
            data = f.read(READ if left < 0 else min(READ, left))
            if not data:
                return
            left -= len(data) if left > 0 else 0
            yield data


def facts_of(root: str | None, path: str, want: tuple[str, ...], algorithm: str = "sha256", read_limit: int = READ_LIMIT) -> dict:
    """What is wanted of one file, in one reading of it, which ends where nothing more is needed; all null where the
    file cannot be read, or a link stands in its place or that of a folder above it."""
    running = {}
    if "hash" in want:
        running["hash"] = Blake3() if algorithm == "blake3" else hashlib.sha256()
    if "sample" in want:
        running["sample"] = hashlib.sha256()
    if "sig" in want:
        running["sig"] = Simhash()
    most = {"hash": -1, "sample": SAMPLE_BYTES, "sig": read_limit}
    limit = -1 if any(most[k] < 0 for k in running) else max((most[k] for k in running), default=0)
    size = 0
    try:
        for data in pieces(root, path, end=None if limit < 0 else limit):
            for k, state in running.items():
                part = data if most[k] < 0 else data[: max(0, most[k] - size)]
                if part:
                    state.update(part)
            size += len(data)
    except OSError:
        return dict.fromkeys(want)
    out = {k: s.value() if k == "sig" else s.hexdigest() for k, s in running.items()}
    return out | {"bytes_read": size}


def _read(batches: Iterator[pa.RecordBatch], want: tuple[str, ...], algorithm: str, read_limit: int) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            roots = part.column("root").to_pylist() if "root" in part.schema.names else [None] * part.num_rows
            found = [facts_of(r, p, want, algorithm, read_limit) for r, p in zip(roots, part.column("path").to_pylist())]
            columns = [pa.array([x[k] for x in found], kinds[KINDS[k]]) for k in want]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *want])


def with_facts(files: DataFrame, want: tuple[str, ...] = ("hash",), algorithm: str = "sha256", read_limit: int = READ_LIMIT, tasks: int | None = None) -> DataFrame:
    """``files`` (``path`` and, if links above a file are not to be followed, ``root``) with the wanted columns:
    ``hash`` of all bytes, ``sample`` of the first 4 KiB, ``sig``, a simhash of the first ``read_limit`` bytes (below 0:
    of all), ``bytes_read``. Each file is read once, in pieces; a task holds one piece. All are null where a file cannot
    be read. Files are dealt out evenly by their paths first, as reading is the work (``tasks``: to so many)."""
    parse_algorithm(algorithm)
    unknown = set(want) - set(KINDS)
    if unknown:
        raise ValueError(f"not a fact of a file: {sorted(unknown)}")
    bound_batches(files.sparkSession)
    rest = files.drop(*want)
    dealt = rest.repartition(tasks, "path") if tasks else rest.repartition("path")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), *(f"{k} {KINDS[k]}" for k in want)])
    return dealt.mapInArrow(functools.partial(_read, want=tuple(want), algorithm=parse_algorithm(algorithm), read_limit=read_limit), schema)


def blake3_by_ranges(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """``(path, hash)``: BLAKE3 of large files, of which each range is hashed by a task of its own and the ranges'
    chaining values are merged. A file that has shrunk or cannot be read has a null hash. For files over one range."""
    if range_bytes % PIECE or (range_bytes // PIECE) & (range_bytes // PIECE - 1):
        raise ValueError("a range is a power of two of pieces")
    root = F.col("root") if "root" in files.columns else F.lit(None).cast("string")
    count = F.ceil(F.col("size") / range_bytes).cast("int")
    ranges = files.where(F.col("size") > range_bytes).select("path", root.alias("root"), "size", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                begin, end = r["k"] * range_bytes, min(r["size"], (r["k"] + 1) * range_bytes)
                parts, held, at = [], b"", begin
                try:
                    for data in pieces(r["root"], r["path"], begin, end):
                        held += data
                        while len(held) >= PIECE:
                            parts.append(subtree(held[:PIECE], at))
                            held, at = held[PIECE:], at + PIECE
                    if held:
                        parts.append(subtree(held, at))
                        at += len(held)
                except OSError:
                    at = -1
                found.append(merged(np.stack(parts)).astype("<u4").tobytes() if at == end else None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("n"), batch.column("k"), pa.array(found, pa.binary())], names=["path", "n", "k", "value"])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if len(x) != n else _whole(b"".join(v["value"] for v in x)) for x, n in zip(batch.column("values").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "hash"])

    parts = ranges.repartition("path", "k").mapInArrow(values, "path string, n int, k int, value binary")
    told = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("k", "value")))
    return parts.groupBy("path", "n").agg(F.sort_array(told).alias("values")).mapInArrow(roots, "path string, hash string")


def _whole(data: bytes) -> str:
    return merged(np.frombuffer(data, "<u4").reshape(-1, 8).astype(np.uint32), root=True).astype("<u4").tobytes().hex()
