"""Byte-pair encoding and decoding of whole texts, through a table of distinct pre-tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.wordtable import BLOCK, Block, Values, Vocabulary, give_back, join_by_word
from twinlake.session import bound_batches


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary file of the tokenizers library, special strings included."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return Vocabulary(path, True, tuple(x["content"] for x in added))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[start:start+length]`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per row of ``docs`` in no given order; with ``decoded`` also
    ``text``, what ``decode`` makes of the ids, in the same task.

    Ids are those of the whole text under the tokenizer file at ``path`` without added special tokens;
    special strings inside a text are encoded as the library does by default. A null text is empty and
    has no ids; null and repeated ids and repeated rows are kept as they are; other columns are not read;
    an empty table gives an empty one. Texts of any length are encoded whole.
    """

    items = pieces(path)
    narrow = len(items) <= 1 << 16
    kind_of_id, shift = (np.uint16, 1) if narrow else (np.uint32, 2)

    def to_bytes(ids: list[list[int]]) -> list[bytes]:
        return [np.array(x, kind_of_id).tobytes() for x in ids]

    def finish(rows: pa.Table, block: Block, values: Values) -> list[pa.RecordBatch]:
        table = piece_arrays(items) if decoded else None
        lengths, starts, flat = values.lengths >> shift, values.starts >> shift, values.flat.view(kind_of_id)
        names, out, row = rows.column("doc_id").combine_chunks(), [], 0
        for own, places, bounds in block.chunks:
            at = own[places]
            size = lengths[at]
            ids = gather(flat, starts[at], size).astype(np.int32)
            offsets = np.append(0, np.cumsum(size))[bounds]
            columns = [names.slice(row, len(bounds) - 1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
            out.append(pa.RecordBatch.from_arrays([*columns, decoded_texts(ids, offsets, table)] if decoded else columns, names=["doc_id", "ids", "text"][: 2 + decoded]))
            row += len(bounds) - 1
        return out or rows.select(["doc_id"]).append_column("ids", pa.array([], pa.list_(pa.int32()))).to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", text string" * decoded
    return join_by_word(docs, id_col, text_col, byte_level(path), to_bytes, finish, schema, block_bytes)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """``(doc_id, ids, text)``: ``encode``, and ``decode`` of its ids in the tasks that joined them."""
    return encode(docs, path, id_col, text_col, block_bytes, decoded=True)


def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes of each id. Its size is that of the vocabulary file."""
    with open(path, encoding="utf-8") as f:
        table = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocabulary = table["model"]["vocab"]
    out = [b""] * (1 + max([*vocabulary.values(), *(x["id"] for x in table["added_tokens"])]))
    for piece, k in vocabulary.items():
        out[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    for x in table["added_tokens"]:
        out[x["id"]] = x["content"].encode()
    return out


def decoded_texts(ids: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The texts of rows of ids; bytes that are not UTF-8 become replacement characters."""
    flat, starts, lengths = table
    size = lengths[ids]
    data = gather(flat, starts[ids], size)
    ends = np.append(0, np.cumsum(size))[offsets]
    texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    try:
        return texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())


def piece_arrays(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths


def id_slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, row offsets)`` of whole rows of a list column, about ``most`` ids at a time."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield flat[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, text)``: the ids joined with the id-to-piece table and their bytes strung together,
    special tokens included; bytes that are not UTF-8 become replacement characters. Null ids give the
    empty text. The table is part of the vocabulary file, so its size does not depend on the data."""
    items = pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_arrays(items)
        for batch in batches:
            row = 0
            for ids, offsets in id_slices(batch.column("ids")):
                part = batch.slice(row, len(offsets) - 1)
                row += len(offsets) - 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), decoded_texts(ids, offsets, table)], names=["doc_id", "ids", "text"])
            give_back()

    bound_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()
    some = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return some.mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
