"""Vectorised scanning of text columns: words, their 64-bit hashes, and tokenizer pre-tokens.

Everything works on whole Arrow batches with NumPy, in chunks of a few MB, so memory does not depend
on the number of rows; a single text longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer spans are hashed one by one.
LONG_SPAN = 512
_ALL = (1 << 64) - 1
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes ``data[start:end]`` of each span: equal spans have equal hashes wherever they
    stand. Eight bytes a step go through a bijective scrambling.

    Spans that share a hash can be constructed by whoever knows the ``key``. Where equal hashes count as equal words,
    a caller draws a ``secret_key`` for each run, or compares the bytes."""
    sizes = ends - starts
    out = mix((sizes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & _ALL))
    factor = np.uint64(key >> 64 | 1)  # odd, so this is a bijection as well
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), np.uint64, padded, 0, (1,))
    long = sizes > LONG_SPAN
    for k in np.flatnonzero(long).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]], digest_size=8, key=key.to_bytes(16, "little") if key else b"").digest(), "little")
    some = np.flatnonzero((sizes > 0) & ~long)
    at, left = starts[some], sizes[some]
    while len(some):
        out[some] = mix(out[some] ^ (lanes[at] & _LOW_BYTES[np.minimum(left, 8)])) * factor + np.uint64(0x632BE59BD9B4E019)
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return out


def secret_key() -> int:
    """A key of 128 bits for one run, drawn by the driver and known to its tasks alone."""
    return secrets.randbits(128)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null rows are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` pieces of whole rows, about ``limit`` bytes each."""
    values, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, values[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_class(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``blank``: all but ``[\\x20\\x09-\\x0D]``; ``alnum``: ASCII letters and
    digits and every byte of characters beyond ASCII."""
    k = np.arange(256)
    if kind == "blank":
        return ~((k == 32) | ((k >= 9) & (k <= 13)))
    return ((k >= 48) & (k <= 57)) | ((k >= 65) & (k <= 90)) | ((k >= 97) & (k <= 122)) | (k >= 128)


_CLASSES = {kind: word_class(kind) for kind in ("blank", "alnum")}


def words(values: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, per row, where its words begin in them (one more entry than rows)."""
    inside = _CLASSES[kind][values]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def lower_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """Hashes of spans with A-Z taken as a-z."""
    return span_hashes(_LOWER[values], starts, ends, key)


def hash_words(text: str, kind: str, key: int = 0) -> np.ndarray:
    """The word hashes of one text, as ``words`` and ``lower_hashes`` give them for columns."""
    values = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(values, np.array([0, len(values)]), kind)
    return lower_hashes(values, starts, ends, key)


# ---------------------------------------------------------------- pre-tokens, by code point

OTHER, LETTER, NUMBER, SPACE, WHOLE = range(5)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What the public split patterns cut off after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@functools.cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def pretokens(sections: list[str], whole: np.ndarray, attach_space: bool) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all sections, and where each section's begin in them (one more entry than sections).

    ``attach_space``: the byte-level pattern, in which a space joins what follows and white space makes
    tokens; otherwise the word pattern, in which white space is dropped and each number character stands
    alone. Sections with ``whole`` set (special tokens) are one pre-token each.
    """
    joined = "".join(sections)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(sections) + 1, np.int64)
    np.cumsum([len(s) for s in sections], out=bounds[1:])
    n = len(points)
    kinds = _classes()[points]
    if whole.any():
        for k in np.flatnonzero(whole):
            kinds[bounds[k] : bounds[k + 1]] = WHOLE
    fresh = np.ones(n, bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    run = fresh.copy()
    run_starts = np.flatnonzero(run)
    run_ends = np.append(run_starts[1:], n)
    filled = np.zeros(n + 1, bool)
    filled[bounds] = True
    if attach_space:
        k = np.flatnonzero((kinds[run_starts] == SPACE) & ~filled[run_ends]) if n else run_starts
        last = run_ends[k] - 1
        fresh[last] = True
        joins = points[last] == 32
        fresh[last[joins] + 1] = False
    else:
        fresh |= kinds == NUMBER
    ticks = run_starts[(points[run_starts] == 39) & fresh[run_starts] & (run_ends - run_starts == 1) & (kinds[run_starts] == OTHER)] if n else run_starts
    if attach_space and len(ticks):
        ticks = ticks[(ticks == 0) | fresh[ticks]]
    if len(ticks):
        padded = np.append(points, [0, 0, 0]).astype(np.uint32)
        edge = np.append(filled, [True, True, True])
        for tail in CONTRACTIONS:
            hit = ticks[~edge[ticks + 1]]
            for k, ch in enumerate(tail):
                hit = hit[padded[hit + 1 + k] == ord(ch)]
                hit = hit[~edge[hit + 1 + k]]
            fresh[hit + 1] = False
            after = hit + 1 + len(tail)
            after = after[after < n]
            # what follows begins anew, unless a space before it already holds it
            fresh[after] = True
    starts = np.flatnonzero(fresh)
    width = np.ones(n + 1, np.int64)
    for least in (0x80, 0x800, 0x10000):
        width[1:] += points >= least
    width[0] = 0
    offsets = np.cumsum(width)[np.append(starts, n)]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())])
    if not attach_space:
        keep = kinds[starts] != SPACE
        starts, words = starts[keep], words.filter(pa.array(keep))
    return words, np.searchsorted(starts, bounds)
