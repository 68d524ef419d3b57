"""WARC archives as a table of chunks: written from pages, read back, exported to and imported from files."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.operators.keyfilter import flagged
from twinlake.session import bound_batches

CHUNK = 64 << 10
LEAST_REVISIT = 1000
CHUNKS = "record string, chunk int, chunks int, data binary, sha1 string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def page_payloads(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: the id of the record that a page's record revisits, or null.

    Of pages with equal payloads (SHA-1, length and a second hash) of at least ``least`` bytes, the one
    with the largest id holds the payload. Pages without an id refer to none and are referred to by none. Null
    html is empty; repeated ids and rows are records of their own; no pages give no records.
    """
    key = ["page_id", "sha1", "n", "check"]
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"sha1": F.sha1("payload"), "n": F.octet_length("payload"), "check": F.xxhash64("payload")}
    )
    large = rows.where((F.col("n") >= least) & F.col("page_id").isNotNull()).select(*key)
    kept = large.groupBy("sha1", "n", "check").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = cut(large.distinct().join(kept, ["sha1", "n", "check"]).where("page_id <> refers_to"))
    # only payloads that may be there more than once are brought to what is known of them
    told = flagged(rows, again, key, "told")
    some = told.where("told").join(again, key, "left").select("page_id", "url", "payload", "refers_to")
    return some.unionByName(told.where("not told").select("page_id", "url", "payload", F.lit(None).cast(again.schema["refers_to"].dataType).alias("refers_to")))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def write_records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """The chunk table of one record per row of ``page_payloads``: ``(record, chunk, chunks, data, sha1)``.

    Ids are integers; a null id gives a record without one. The ``data`` of a record's chunks in order are the bytes of the record: chunk 0 is the header with the
    first bytes of the payload, the last ends with the record's blank lines. ``sha1`` is the digest of the payload up to the chunk's end, carried on from chunk to chunk.
    Payloads over ``chunk`` bytes are never copied whole: views of them go out one by one.
    """

    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            payloads = batch.column("payload")
            for k, (page, url, other) in enumerate(zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("refers_to").to_pylist())):
                payload = memoryview(payloads[k].as_buffer())
                record, row = f"{task}-{row}", row + 1
                digest, states = hashlib.sha1(), []
                for a in range(0, max(1, len(payload)), chunk):
                    digest.update(payload[a : a + chunk])
                    states.append(digest.hexdigest())
                body = payload if other is None else payload[:0]
                fields = [
                    ("WARC-Type", "response" if other is None else "revisit"),
                    ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
                    ("WARC-Date", date),
                    *([("WARC-Target-URI", _clean(url))] if url else []),
                    ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest.digest()).decode()}"),
                    *([("WARC-Refers-To", f"<urn:page:{other}>"), ("WARC-Profile", PROFILE)] if other is not None else []),
                    ("Content-Type", "text/html; charset=utf-8"),
                    ("Content-Length", str(len(body))),
                ]
                spans = range(0, max(1, len(body)), chunk)
                for n, a in enumerate(spans):
                    last = n + 1 == len(spans)
                    data = b"".join(([_header(fields)] if n == 0 else []) + [body[a : a + chunk]] + ([b"\r\n\r\n"] if last else []))
                    rows.append((record, n, len(spans), data, states[n] if other is None else digest.hexdigest()))
                    size += len(data)
                    if size > 4 << 20:
                        yield _chunk_batch(rows)
                        rows, size = [], 0
        if rows:
            yield _chunk_batch(rows)

    return pages.mapInArrow(run, CHUNKS)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["record", "chunk", "chunks", "data", "sha1"])


class Reader:
    """Reads records chunk by chunk; holds a header and a digest state, never a whole record."""

    def __init__(self):
        self.fields: dict[str, str] = {}
        self.left, self.size, self.digest = 0, 0, hashlib.sha1()

    def feed(self, data: bytes, first: bool, sha1: str) -> None:
        view = memoryview(data)
        if first:
            head = data.index(b"\r\n\r\n")
            lines = data[:head].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = self.size = int(self.fields["Content-Length"])
            self.digest = hashlib.sha1()
            view = view[head + 4 :]
        part = view[: self.left]
        self.digest.update(part)
        self.left -= len(part)
        if self.size and self.digest.hexdigest() != sha1:
            raise ValueError("a chunk's digest does not follow from the chunks before it")

    def row(self) -> tuple:
        fields = self.fields
        want = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        response = fields["WARC-Type"] == "response"
        if self.left or response and self.digest.hexdigest() != want:
            raise ValueError("a record's payload does not have its digest")
        page, other = (fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
        return int(page) if page else None, self.size if response else None, want, fields["WARC-Type"], int(other) if other else None


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        out = []
        for chunk, chunks, data, sha1 in zip(*(batch.column(c).to_pylist() for c in ("chunk", "chunks", "data", "sha1"))):
            reader.feed(data, chunk == 0, sha1)
            if chunk + 1 == chunks:
                out.append(reader.row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in ROWS.split(", ")])


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Every chunk's and every payload's digest is checked. Records of one chunk are read where they lie;
    only oversized ones are brought together by record and chunk number, and streamed. The size of a
    revisit's payload is that of the response it refers to. An empty table gives an empty result.
    """
    columns = ["record", "chunk", "chunks", "data", "sha1"]
    whole = chunks.where("chunks = 1").select(*columns).mapInArrow(_rows, ROWS)
    large = chunks.where("chunks > 1").select(*columns).repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_rows, ROWS)
    return whole.unionByName(large)


def with_revisits(records: DataFrame) -> DataFrame:
    """Fill in the payload sizes of revisit records from the responses they refer to."""
    wanted = records.where("refers_to is not null").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    sizes = records.where("record_type = 'response'").join(wanted, ["page_id", "payload_digest"], "left_semi").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("full"))
    sizes = sizes.withColumnRenamed("page_id", "refers_to")
    return records.join(sizes, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def export_files(chunks: DataFrame, folder: str) -> None:
    """Write one ``.warc`` file per partition of a chunk table into ``folder``, a path that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}.warc"
        os.makedirs(folder, exist_ok=True)
        with open(f"{name}.{task.taskAttemptId()}", "wb") as f:
            for batch in batches:
                for data in batch.column("data"):
                    f.write(data.as_buffer())
        os.replace(f.name, name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    dealt = chunks.repartition("record").sortWithinPartitions("record", "chunk")
    dealt.mapInArrow(run, "file string").count()


def chunks_of_file(path: str, chunk: int = CHUNK) -> Iterable[tuple[str, int, int, bytes, str]]:
    """The chunk rows of a ``.warc`` file, read a chunk at a time."""
    with open(path, "rb") as f:
        number = 0
        while line := f.readline():
            head = [line]
            while head[-1] != b"\r\n":
                head.append(f.readline())
                if not head[-1]:
                    raise ValueError("the file ends within a header")
            left = next(int(x.split(b":")[1]) for x in head if x.lower().startswith(b"content-length:"))
            n, total, digest = 0, max(1, -(-left // chunk)), hashlib.sha1()
            revisit = b"WARC-Type: revisit\r\n" in head
            known = next((x.split(b"sha1:")[1].strip() for x in head if x.startswith(b"WARC-Payload-Digest:")), b"")
            while n < total:
                part = f.read(min(chunk, left))
                left -= len(part)
                digest.update(part)
                data = (b"".join(head) if n == 0 else b"") + part + (f.read(4) if n + 1 == total else b"")
                yield f"{path}-{number}", n, total, data, base64.b32decode(known).hex() if revisit else digest.hexdigest()
                n += 1
            number += 1


def import_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The chunk table of ``.warc`` files on a path that all executors share, a task per file."""
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for row in chunks_of_file(path):
                    rows.append(row)
                    if len(rows) >= 64:
                        yield _chunk_batch(rows)
                        rows = []
                if rows:
                    yield _chunk_batch(rows)

    return names.mapInArrow(run, CHUNKS)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
w AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to FROM w
"""
