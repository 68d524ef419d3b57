"""Token counts of whole texts from counts of distinct pre-tokens."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinlake.llm.wordtable import BLOCK, Block, Values, Vocabulary, join_by_word


def word_level(path: str) -> Vocabulary:
    """A word-end vocabulary file of the tokenizers library: folded texts, white space dropped."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return Vocabulary(path, False, tuple(x["content"] for x in added), fold=True)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row, in no given order.

    Pieces are counted once per distinct pre-token; per document the frequencies of its pre-tokens are
    joined with those counts and summed, so no ids are made. Special strings inside a text count one each.
    A null text is empty: 0 bytes, 0 tokens. Null and repeated ids and repeated rows are kept; texts of any
    length are counted whole; other columns are not read; an empty table gives an empty one.
    """

    def sizes(ids: list[list[int]]) -> list[bytes]:
        return [np.uint32(len(x)).tobytes() for x in ids]

    def finish(rows: pa.Table, block: Block, values: Values) -> list[pa.RecordBatch]:
        counts = values.flat.view(np.uint32).astype(np.int64)[values.starts >> 2]
        out = []
        for own, places, bounds in block.chunks:
            ends = np.append(0, np.cumsum(counts[own][places]))
            out.append(np.diff(ends[bounds]))
        n = np.concatenate(out) if out else np.zeros(0, np.int64)
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes"), "n_tokens": n, "over_limit": n > limit}).to_batches(10_000)

    kind = docs.schema[id_col].dataType.simpleString()
    return join_by_word(docs, id_col, text_col, word_level(path), sizes, finish, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", block_bytes)
