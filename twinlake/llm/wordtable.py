"""Distinct pre-token tables: each distinct pre-token is encoded once and joined back by position.

Rows are dealt into blocks of about ``BLOCK`` bytes by a hash of their content, copies of a row to different
blocks; they travel as compressed packets of the rows that a task has for a block. Per block, the distinct
pre-tokens go out as one packed payload per bucket of the pre-token hash; a bucket's task sees a pre-token from
all blocks and encodes it once; the results travel back to the blocks and are joined with the texts there, by
pre-token. What is shuffled is the texts once and each block's distinct pre-tokens twice. A task holds a block's
packets and pre-tokens, one packet's texts at a time, and ``CACHE`` pre-tokens in a bucket's task; a text that is longer
than a block makes its block longer.

Pre-tokens are told apart by their bytes, within a block and across blocks; hashes only deal them out.
"""

from __future__ import annotations

import functools
import itertools
import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm import textscan
from twinlake.session import bound_batches, give_back

BLOCK = 8 << 20
CACHE = 500_000
MOST_TASKS = 20_000
#: Bytes of a packet before it is compressed, at most, but for a longer text.
PACKET = 1 << 20
#: Characters that are cut into pre-tokens at once.
PIECE = textscan.CHUNK // 4


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file and how its texts fall into pre-tokens."""

    path: str
    attach_space: bool
    special: tuple[str, ...]
    fold: bool = False  # NFC, white space to one space, lower case

    def sections(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings; each of those is one pre-token."""
        parts = [(text, False)]
        for word in self.special:
            if word in text:
                parts = [
                    piece
                    for part, whole in parts
                    for piece in ([(part, True)] if whole else [x for k, s in enumerate(part.split(word)) for x in ([(word, True)] if k else []) + [(s, False)]])
                ]
        return [(part if whole or not self.fold else folded(part), whole) for part, whole in parts]

    def encoder(self):
        """The tokenizer, for single pre-tokens: neither normalises nor splits further."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if self.fold:
            tokenizer.normalizer = normalizers.Sequence([])
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return lambda batch: [x.ids for x in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


def folded(text: str) -> str:
    """NFC and lower case, character by character (a sigma has one lower form wherever it stands)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


#: Words of a block's dictionaries before they are merged.
MERGE = 200_000


class Block:
    """The distinct pre-tokens of the texts of one block, told apart by their bytes, and where they stand."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.dictionaries: list[pa.Array] = []
        self.held = 0
        #: For each chunk of texts: the place in ``words`` of each of its distinct pre-tokens (once closed), which of
        #: those stands where, and row bounds.
        self.chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.words, self.buckets = pa.array([], pa.large_string()), np.zeros(0, np.int32)

    def add(self, texts: list[str], keep_places: bool) -> None:
        start, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size > PIECE or k + 1 == len(texts):
                self._chunk(texts[start : k + 1], keep_places)
                start, size = k + 1, 0

    def _chunk(self, texts: list[str], keep_places: bool) -> None:
        cut = [self.vocabulary.sections(t) for t in texts]
        flat = [s for x in cut for s, _ in x]
        whole = np.array([w for x in cut for _, w in x], bool)
        words, bounds = textscan.pretokens(flat, whole, self.vocabulary.attach_space)
        coded = words.dictionary_encode()
        self.dictionaries.append(coded.dictionary)
        if keep_places:
            rows = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(x) for x in cut], out=rows[1:])
            self.chunks.append((np.zeros(len(coded.dictionary), np.int64), coded.indices.to_numpy(), bounds[rows]))
            return
        self.held += len(coded.dictionary)
        if self.held > MERGE:
            self.dictionaries = [pa.concat_arrays(self.dictionaries).unique()]
            self.held = len(self.dictionaries[0]) // 2  # so that merging stays rare, whatever the number of words

    def close(self, buckets: int) -> None:
        """Put the distinct pre-tokens in the order of bucket, hash and bytes, whatever the order of the texts."""
        merged = pa.concat_arrays(self.dictionaries).dictionary_encode() if self.dictionaries else self.words.dictionary_encode()
        words = merged.dictionary
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        hashes = textscan.span_hashes(data, offsets[:-1], offsets[1:])
        bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((hashes, bucket))
        if len(order) and (hashes[order][1:] == hashes[order][:-1]).any():  # words that share a hash
            texts = words.to_pylist()
            order = np.array(sorted(range(len(texts)), key=lambda k: (bucket[k], hashes[k], texts[k].encode())))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, start = place[merged.indices.to_numpy()], 0
        for k, (own, places, bounds) in enumerate(self.chunks):
            self.chunks[k] = (at[start : start + len(own)], places, bounds)
            start += len(own)
        self.words, self.buckets, self.dictionaries = words.take(pa.array(order)), bucket[order], []

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        """``(bucket, packed words)`` in order."""
        offsets = np.frombuffer(self.words.buffers()[1], np.int64)[: len(self.words) + 1] if len(self.words) else np.zeros(1, np.int64)
        data = self.words.buffers()[2]
        edges = [0, *(np.flatnonzero(self.buckets[1:] != self.buckets[:-1]) + 1).tolist(), len(self.buckets)] if len(self.buckets) else [0]
        for a, b in zip(edges, edges[1:]):
            yield int(self.buckets[a]), packed(np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]])


def packed(lengths: np.ndarray, data) -> bytes:
    """Items of these lengths, whose bytes stand one after another in ``data``."""
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(lengths)).tobytes() + lengths.astype(np.uint32).tobytes() + bytes(data))


def pack(items: list[bytes]) -> bytes:
    return packed(np.array([len(x) for x in items], np.uint32), b"".join(items))


def unpack(payload: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(data, np.uint32, n, 4).astype(np.int64)) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def unpack_arrays(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of packed items, and their bytes one after another."""
    data = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.frombuffer(data, np.uint32, n, 4).astype(np.int64), np.frombuffer(data, np.uint8, -1, 4 + 4 * n)


def dealt_blocks(keys: np.ndarray, blocks: int) -> np.ndarray:
    """A block for each key; repeated keys go to neighbouring blocks, so no number of copies fills one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    heads = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    place = np.arange(len(keys))
    out = np.empty(len(keys), np.int32)
    out[order] = (ordered.view(np.uint64) + (place - np.maximum.accumulate(np.where(heads, place, 0))).astype(np.uint64)) % np.uint64(blocks)
    return out


def packets(batches: Iterator[pa.RecordBatch], blocks: int, flush: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``(key, doc_id, text)`` rows as ``(block, payload)``: the compressed rows of one block among a few MB."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        block = dealt_blocks(table.column("key").to_numpy(), blocks)
        order = np.argsort(block, kind="stable")
        block = block[order]
        table = table.select(["doc_id", "text"]).take(pa.array(order)).combine_chunks()
        size = np.append(0, np.cumsum(pc.binary_length(table.column("text")).to_numpy()))
        piece = size[:-1] // PACKET
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (piece[1:] != piece[:-1])) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table.slice(a, b - a).combine_chunks())
            payload = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a])], pa.int32()), pa.array([payload], pa.binary())], names=["block", "payload"])

    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * flush // max(1, batch.nbytes))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            held.append(part)
            size += part.nbytes
            if size >= flush:
                yield from packed(held)
                held, size = [], 0
    if held:
        yield from packed(held)
        held = []
    give_back()


def opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def _segments(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """Pieces of batches sorted by ``key`` that hold one key; True with the first piece of a key."""
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(keys[a]), batch.slice(a, b - a), keys[a] != last
                last = keys[a]


@dataclass
class Values:
    """A value for each distinct pre-token of a block, in their order, as bytes one after another."""

    starts: np.ndarray
    lengths: np.ndarray
    flat: np.ndarray


def join_by_word(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary, encode: Callable[[list[list[int]]], list[bytes]],
    finish: Callable[[pa.Table, Block, Values], list[pa.RecordBatch]], schema: str, block_bytes: int = BLOCK,
) -> DataFrame:
    """``finish(rows, block, values)`` for each block, whose rows are ``(doc_id, n_bytes)``.

    ``encode`` turns the ids of distinct pre-tokens into the values to send back. Null texts are empty.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    tasks = min(blocks, MOST_TASKS)
    # a block's payloads hold about a hundred pre-tokens or more; beyond 2048 buckets only their tasks grow longer
    buckets = 4 * min(max(blocks, 12), 512)
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    dealt = keyed.mapInArrow(functools.partial(packets, blocks=blocks), "block int, payload binary").repartition(tasks, "block")

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            block.close(buckets)
            parts = block.payloads()
            while some := list(itertools.islice(parts, 64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.int32()), pa.array([p[0] for p in some], pa.int32()), pa.array([p[1] for p in some], pa.binary())], names=["block", "bucket", "payload"]
                )

        for key, piece, first in _segments(batches, "block"):
            if first:
                if block is not None:
                    yield from flush()
                block, name = Block(vocabulary), key
                give_back()
            for payload in piece.column("payload"):
                block.add(opened(payload.as_buffer()).column("text").to_pylist(), False)
        if block is not None:
            yield from flush()
        block = None
        give_back()

    def values_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, cache = vocabulary.encoder(), {}
        for batch in batches:
            for k, payload in enumerate(batch.column("payload")):
                words = unpack(payload.as_buffer())
                if len(cache) > CACHE:
                    cache.clear()
                new = [w for w in words if w not in cache]
                for a in range(0, len(new), 10_000):
                    part = new[a : a + 10_000]
                    cache.update(zip(part, encode(tokenize([w.decode() for w in part]))))
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column("block"), one.column("bucket"), pa.array([pack([cache[w] for w in words])], pa.binary())], names=["block", "bucket", "payload"])
        cache.clear()
        tokenize = None
        give_back()

    def join(sent: pa.Table, payloads: pa.Table) -> pa.Table:
        block, held = Block(vocabulary), []
        for payload in sent.column("payload"):
            part = opened(payload.as_buffer())
            block.add(part.column("text").to_pylist(), True)
            held.append(part.select(["doc_id"]).append_column("n_bytes", pc.binary_length(part.column("text")).cast(pa.int64())))
        block.close(buckets)
        column = payloads.column("payload")
        parts = [unpack_arrays(column[k].as_buffer()) for k in np.argsort(payloads.column("bucket").to_numpy(), kind="stable").tolist()]
        lengths = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint8)
        if len(lengths) != len(block.words):
            raise RuntimeError("the distinct pre-tokens of a block differ between its two readings")
        out = pa.Table.from_batches(finish(pa.concat_tables(held), block, Values(np.cumsum(lengths) - lengths, lengths, flat)))
        del block, held, parts, lengths, flat, sent, payloads, column
        give_back()
        return out

    payload = "block int, bucket int, payload binary"
    # both readings take the same columns, so they share one exchange of the texts
    sent = dealt.sortWithinPartitions("block").mapInArrow(words_out, payload)
    back = sent.repartition(min(buckets, max(blocks, 12)), "bucket").mapInArrow(values_back, payload)
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(join, schema)
