"""One document that many tasks write in place: each knows from the sums of what is before it where its part begins."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from twinlake.checkpoints import cut
from twinlake.operators.groups import LONG
from twinlake.session import bound_batches

#: Bytes that are written at once.
WRITE = 1 << 20
ORDER = ["match_type", "match_key", "hash", "path"]


class State(NamedTuple):
    """Where a reader of the ordered rows is: the group of the row before, how many rows of it there were, and how
    many groups have begun."""

    group: tuple | None = None
    rows: int = 0
    groups: int = 0

    def after(self, group: tuple) -> State:
        return State(group, self.rows + 1, self.groups) if group == self.group else State(group, 1, self.groups + 1)


def _say(value) -> str:
    text = json.dumps(value, ensure_ascii=False)
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def json_row(row: tuple, before: State) -> str:
    """What a row adds to a JSON document: its file, and the ends and heads of groups between it and the row before."""
    file = f'\n        {{\n          "path": {_say(row[4])},\n          "size": {_say(row[5])}\n        }}'
    if row[:4] == before.group:
        return "," + file
    head = "".join(f'      "{name}": {_say(value)},\n' for name, value in zip(LONG, row[:4]))
    return ("\n      ]\n    }," if before.groups else "") + "\n    {\n" + head + '      "files": [' + file


def csv_row(row: tuple, before: State | None = None) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(row)
    return out.getvalue()


#: What stands before a group's key in a text.
LABELS = {"content": "Hash", "name": "Name", "fuzzy": "Similar"}


def numbered_row(row: tuple, before: State) -> str:
    head = "" if row[:4] == before.group else f"{LABELS[row[0]]}: {row[1]}\n"
    return f"{head} {before.after(row[:4]).rows}: {row[4]}\n"


def bullet_row(row: tuple, before: State) -> str:
    head = "" if row[:4] == before.group else f"{LABELS[row[0]]}: {row[1]}\n"
    return f"{head}  - {row[4]}\n"


def rendered(rows: Iterator[tuple], render: Callable[[tuple, State], str], state: State = State()) -> Iterator[str]:
    for row in rows:
        yield render(row, state)
        state = state.after(row[:4])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _per_part(ordered: DataFrame, work: Callable[[int, Iterator[tuple]], dict | None], schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches):
        told = work(TaskContext.get().partitionId(), _rows(batches))
        if told is not None:
            yield pa.RecordBatch.from_pylist([told], schema=schema)

    return ordered.mapInArrow(run, ddl)


#: What is told of a part: its first group, how many rows that has at the part's beginning, its last group, how many
#: rows that has at its end, and how many groups it has in all.
_GROUP = pa.list_(pa.string())
_EDGES = pa.schema([("part", pa.int32()), ("first", _GROUP), ("last", _GROUP), ("run", pa.int64()), ("groups", pa.int64())])


def _edges(part: int, rows: Iterator[tuple]) -> dict | None:
    first, state = None, State()
    for row in rows:
        first = first or row[:4]
        state = state.after(row[:4])
    told = lambda g: [*g[:3], str(g[3])]
    return first and {"part": part, "first": told(first), "last": told(state.group), "run": state.rows, "groups": state.groups}


def _states(edges: list) -> tuple[dict[int, State], int]:
    """The state before each part that has rows, and the number of groups in all."""
    before, state = {}, State()
    for e in sorted(edges, key=lambda e: e.part):
        first, last = ((*g[:3], int(g[3])) for g in (e.first, e.last))
        before[e.part] = state
        goes_on = first == state.group
        run = e.run + state.rows if goes_on and e.groups == 1 else e.run
        state = State(last, run, state.groups + e.groups - goes_on)
    return before, state.groups


def _bound_pieces(texts: Iterator[str]) -> Iterator[bytes]:
    held, size = [], 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= WRITE:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


def _write_all(file: int, data: bytes, at: int) -> None:
    view = memoryview(data)
    while view:
        n = os.pwrite(file, view, at)
        view, at = view[n:], at + n


def write_document(groups: DataFrame, path: str, render: Callable[[tuple, State], str], head: Callable[[int], str], tail: Callable[[int], str]) -> int:
    """Write groups in report order as one file: ``head`` and ``tail`` of the number of groups, and between them what
    ``render`` makes of each row and the state before it. Returns the bytes written.

    The rows are sorted once, by ranges that may end within a group, and kept in the shared folder. The driver gets the
    edges and the length of each part, a row a part. Then each task writes its part at its place in a new file beside
    ``path``, which all tasks must see at that path (a shared mount); tasks never make that file, so one that does not
    see it fails. A task that is run again, or twice at once, writes the same bytes to the same place. The file has its
    name once all is written; what stood there before stays until then. Its mode is 0600. A folder or an empty
    path is refused. No groups: head and tail alone."""
    if not path or os.path.isdir(path):
        raise ValueError(f"not a file to write: {path!r}")
    bound_batches(groups.sparkSession)
    ordered = cut(groups.select(LONG).orderBy(*ORDER))
    before, count = _states(_per_part(ordered, _edges, _EDGES, "part int, first array<string>, last array<string>, run long, groups long").collect())

    def measure(part, rows):
        size = sum(map(len, _bound_pieces(rendered(rows, render, before.get(part, State())))))
        return {"part": part, "size": size} if size else None

    sizes = _per_part(ordered, measure, pa.schema([("part", pa.int32()), ("size", pa.int64())]), "part int, size long").collect()
    start, end = head(count).encode(), tail(count).encode()
    at, places = len(start), {}
    for part, size in sorted(sizes):
        places[part] = at
        at += size
    folder, name = os.path.split(os.path.abspath(path))
    spare = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")

    def put(part, rows):
        if part not in places:
            return None
        place, file = places[part], os.open(spare, os.O_WRONLY)
        try:
            for data in _bound_pieces(rendered(rows, render, before[part])):
                _write_all(file, data, place)
                place += len(data)
            os.fsync(file)
        finally:
            os.close(file)
        return {"part": part, "size": place - places[part]}

    file = os.open(spare, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    try:
        try:
            os.ftruncate(file, at + len(end))
            _write_all(file, start, 0)
            _write_all(file, end, at)
            written = _per_part(ordered, put, pa.schema([("part", pa.int32()), ("size", pa.int64())]), "part int, size long").collect()
            if sorted(written) != sorted(sizes):
                raise OSError(f"not all parts were written: {path}")
            os.fsync(file)
        finally:
            os.close(file)
        os.replace(spare, path)
    finally:
        if os.path.lexists(spare):
            os.remove(spare)
    return at + len(end)
