"""Directory trees, walked by tasks. Names that begin with ``.`` or ``_`` are files like any other. Trees must be
visible to all executors."""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinlake.checkpoints import cut
from twinlake.plans.config import VIRTUAL, ScanConfig

COLUMNS = "path string, root string, size long, mode int, dev long, ino long, root_dev long, mtime_unix long, mtime_nsec long"
#: Folders that a task lists before it hands on those that are still open, and rows that it sends out at once.
FOLDERS, ROWS = 1000, 10_000


def file_system(path: str, table: str = "/proc/self/mountinfo") -> str:
    """The kind of file system that holds a path, from the mount that its folders lead to; ``unknown`` where the
    machine does not tell."""
    path, best, kind = os.path.realpath(path), "", "unknown"
    try:
        with open(table, encoding="utf-8", errors="surrogateescape") as f:
            mounts = [line.split() for line in f]
    except OSError:
        return kind
    for fields in mounts:
        place = fields[4].replace("\\040", " ")
        inside = path == place or path.startswith(place.rstrip("/") + "/")
        if inside and len(place) >= len(best) and "-" in fields:
            best, kind = place, fields[fields.index("-") + 1]
    return kind


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _listing(folder: str) -> list[str]:
    """Names in order; what cannot be read is passed over."""
    try:
        return sorted(os.listdir(folder))
    except OSError:
        return []


@dataclass(frozen=True)
class Pruned:
    """Which folders a walk does not enter: those below ``max_depth`` (-1: none), hidden ones, those of ``folders``,
    and those on another device than the root."""

    max_depth: int = -1
    hidden: bool = True
    folders: frozenset[str] = frozenset()
    one_device: bool = False

    @classmethod
    def by(cls, config: ScanConfig) -> Pruned:
        return cls(config.max_depth, config.hidden, frozenset(f.rstrip("/") or "/" for f in [*config.exclude, *([] if config.virtual else VIRTUAL)]), config.one_file_system)

    def root(self, path: str) -> bool:
        """Whether a root itself lies at or below an excluded folder."""
        while path not in self.folders:
            if path in ("/", ""):
                return False
            path = os.path.dirname(path)
        return True


def _walk(batches: Iterator[pd.DataFrame], pruned: Pruned, most: int) -> Iterator[pd.DataFrame]:
    """``depth`` is null for files; a row with a depth is a folder that is still to be listed."""
    max_depth, hidden = pruned.max_depth, pruned.hidden
    names = [x.split()[0] for x in COLUMNS.split(", ")] + ["depth"]
    work = deque(r for pdf in batches for r in pdf[["path", "root", "root_dev", "depth"]].itertuples(index=False))
    rows: list[tuple] = []
    for _ in range(most):
        if not work:
            break
        folder, root, root_dev, depth = work.popleft()
        if pd.isna(root_dev):
            if pruned.root(folder) or not os.path.isdir(folder):  # a root that is a file has no listing
                continue
            root_dev = _signed(os.lstat(folder).st_dev)
        for name in _listing(folder):
            if name.startswith(".") and not hidden:
                continue
            path = os.path.join(folder, name)
            try:
                s = os.lstat(path)
            except OSError:
                continue
            if stat.S_ISDIR(s.st_mode):
                if (max_depth < 0 or depth < max_depth) and path not in pruned.folders and not (pruned.one_device and _signed(s.st_dev) != root_dev):
                    work.append((path, root, root_dev, depth + 1))
            elif stat.S_ISREG(s.st_mode):
                rows.append((path, root, s.st_size, s.st_mode, _signed(s.st_dev), _signed(s.st_ino), int(root_dev), s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, None))
            if len(rows) == ROWS:
                yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[2:]})
                rows = []
    rows += [(path, root, None, None, None, None, None if pd.isna(dev) else int(dev), None, None, int(depth)) for path, root, dev, depth in work]
    for a in range(0, len(rows), ROWS):
        yield pd.DataFrame(rows[a : a + ROWS], columns=names).astype({c: "Int64" for c in names[2:]})


def scan(spark: SparkSession, paths: list[str], max_depth: int = -1, hidden: bool = True, most: int = FOLDERS, config: ScanConfig | None = None) -> DataFrame:
    """The relation of regular files below ``paths``; links are not followed, what cannot be read is left out. A
    root that is named twice is walked once; a file below two roots is found twice (see ``first_links``).

    With a ``config``, folders that it leaves out (too deep, hidden, excluded, virtual, on another device) are not listed,
    however many files they hold, and neither are hidden files found; other filters are those of ``apply_filters``.

    Tasks list folders in rounds, up to ``most`` each, and what they leave open is dealt out anew for the next;
    no listing goes through the driver."""
    roots = [(p, p, None, 0) for p in dict.fromkeys(os.path.abspath(p) for p in paths)]
    pruned = Pruned(max_depth, hidden) if config is None else Pruned.by(config)
    work, found = spark.createDataFrame(roots, "path string, root string, root_dev long, depth int"), []
    while True:
        out = cut(work.repartition("path").mapInPandas(lambda b: _walk(b, pruned, most), COLUMNS + ", depth int"))
        found.append(out.where("depth is null").drop("depth"))
        work = out.where("depth is not null")
        if work.isEmpty():
            break
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return files


def files_at(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, root, size)`` of single files, wherever they are; what is no regular file is left out. A few paths,
    looked at by one task each."""
    rows = spark.createDataFrame([(os.path.abspath(p),) for p in paths], "path string")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    s = os.lstat(path)
                except OSError:
                    continue
                if stat.S_ISREG(s.st_mode):
                    out.append((path, os.path.dirname(path), s.st_size))
            yield pd.DataFrame(out, columns=["path", "root", "size"])

    return rows.mapInPandas(look, "path string, root string, size long")


def open_below(root: str, path: str) -> int:
    """Open a file without following a link in its place or in that of any folder below the root."""
    flags = os.O_RDONLY | os.O_NOFOLLOW
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        *folders, name = os.path.relpath(path, root).split(os.sep)
        for folder in folders:
            below = os.open(folder, flags | os.O_DIRECTORY, dir_fd=at)
            os.close(at)
            at = below
        return os.open(name, flags, dir_fd=at)
    finally:
        os.close(at)


#: Largest content that ``with_content`` makes a column of, and bytes of a batch of rows with content.
MOST, BATCH = 64 << 20, 8 << 20


def with_content(files: DataFrame, most: int | None = None) -> DataFrame:
    """``content``: the bytes of each file, of its first ``most`` bytes if given; null where it cannot be read
    or a link stands in its place or, where the relation has a ``root``, in that of a folder below it.

    For trees of small files, whose content other operators need as a column. Rows are sent on a few MB at a time; a
    file of more than ``MOST`` bytes is an error: ``content.with_facts`` reads files of any size in pieces."""
    names = [c for c in files.columns if c != "content"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, start, size = [], 0, 0
            roots = batch.column("root").to_pylist() if "root" in names else [None] * batch.num_rows
            for k, (root, path) in enumerate(zip(roots, batch.column("path").to_pylist())):
                data = None
                try:
                    with open(open_below(root or os.path.dirname(path), path), "rb") as f:
                        data = f.read(MOST + 1 if most is None else most)
                except OSError:
                    pass
                if data is not None and len(data) > MOST:
                    raise ValueError(f"too long for a column, read it in pieces: {path}")
                held.append(data)
                size += len(data or b"")
                if size >= BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], names=[*names, "content"])
                    held, start, size = [], k + 1, 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    return files.select(names).mapInArrow(read, schema + ", content binary")
