"""Benchmark decontamination: longest common subsequences of windows with passages, and their latent cosines.

Windows of every text that hold enough of a benchmark passage's words, by exact bounds, are candidates; a
candidate is a leak by its longest common subsequence with the passage and, if reworded, by the passage's
answer. Hashed TF-IDF of all passages is reduced by a distributed randomised SVD; what a leak has of a passage, if
not all of it, must be near the passage in that latent space. Windows are told with their cosines there, which pass
nothing over unless a caller gives a least cosine.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm import textscan
from twinlake.llm.wordtable import give_back
from twinlake.session import bound_batches

u64 = np.uint64
#: Words of a passage: at most the bits of a machine word, for the longest common subsequence.
PASSAGE = 64
#: Windows begin at every BLOCK-th word of a text.
BLOCK = 16
#: Hash buckets of words, columns of the random matrix, singular vectors that are kept.
BUCKETS, COLUMNS, RANK = 1 << 12, 64, 48
#: Passages whose TF-IDF rows are held as a dense matrix at once.
DENSE = 512
#: A leak has this share of a passage in order, or the lesser share, as much of its answer, and words of it that
#: hold this share of its IDF: half of a passage can be words that stand in any text.
SHARE, PART, ANSWER, WEIGHT = 0.75, 0.5, 0.75, 0.4
#: The words that a leak has of a passage have this cosine with the whole passage in the latent space, at least.
LATENT = 0.3
#: Benchmark passages with fewer words are only leaks when whole.
SHORT = 8
#: How much more often than in the corpus a common word stands in texts of its language. It decides which words
#: are left out of a first bound, and with that the time a search takes, but not what it finds.
LOCAL = 4
#: Benchmark passages in a block, and that are compared with a piece of the documents at once.
AT_ONCE, GROUP = 4096, 256
#: Blocks of passages that one scan of the documents looks for, and the bytes of their words that a block waits for.
SCAN, AHEAD = 16, 16 << 20


#: The bits of a word's hash below those of its bucket.
LOW = u64(64 - BUCKETS.bit_length() + 1)


def _word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """Hashes of words whose upper bits, the bucket, are alike in every run, as the weights hang on them; the others
    hang on the ``key``, so that no words can be written to share a hash with those of a passage. 0: no key."""
    plain = textscan.lower_hashes(values, starts, ends)
    if not key:
        return plain
    return plain >> LOW << LOW | textscan.lower_hashes(values, starts, ends, key) >> u64(64) - LOW


def _scan(column: pa.Array, key: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, word hashes, bounds of rows)`` of pieces of a text column."""
    for a, b, values, offsets in textscan.byte_chunks(column):
        starts, ends, at = textscan.words(values, offsets, "alnum")
        yield a, b, _word_hashes(values, starts, ends, key), at


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> LOW).astype(np.int64)


def _cells(at: np.ndarray, width: int) -> np.ndarray:
    """Where cells of ``width`` words begin if each row begins one; the number of words comes last."""
    counts = -(-np.diff(at) // width)
    first = np.repeat(at[:-1] - width * (np.cumsum(counts) - counts), counts)
    return np.append(first + width * np.arange(len(first)), at[-1])


def _padded(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])


def _sums(table: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray, piece: int = 1 << 12) -> np.ndarray:
    """The sums of the rows that the words of spans have in a table, whose last row is zero."""
    out = np.zeros((len(begin), table.shape[1]), table.dtype)
    for a in range(0, len(out), piece):
        mine, low, high = out[a : a + piece], begin[a : a + piece], end[a : a + piece]
        rows = np.empty_like(mine)
        for j in range(int((high - low).max())):
            at = np.where(low + j < high, words[np.minimum(low + j, len(words) - 1)], len(table) - 1)
            mine += table.take(at, axis=0, out=rows, mode="clip")
    return out


@dataclass
class Latent:
    """Word weights and the map from buckets to the latent space, each direction scaled to unit variance; without a
    basis, word weights only."""

    idf: np.ndarray
    basis: np.ndarray | None

    @cached_property
    def weighted(self) -> np.ndarray:
        return _padded(self.basis * self.idf[:, None])

    @cached_property
    def plain(self) -> np.ndarray:
        """As ``weighted``, with directions of length one: rare directions do not outweigh what most words say."""
        return _padded(self.basis / np.maximum(np.linalg.norm(self.basis, axis=0), 1e-12) * self.idf[:, None])

    def rates(self, hashes: np.ndarray) -> np.ndarray:
        """About how often words stand in the corpus, a word: from the share of passages that hold their buckets."""
        share = np.minimum(np.exp(0.1 - self.idf[_buckets(hashes)].astype(np.float64)), 0.999)
        return -np.log1p(-share) / PASSAGE

    def spans(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Latent vectors, of length one, of the bags of words of spans."""
        out = _sums(self.weighted, _buckets(hashes), begin, end)
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


def weights(docs: DataFrame, text_col: str = "text") -> Latent:
    """The IDF of all buckets over all passages of all texts, without a latent space, for callers who want none."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, _, hashes, at in _scan(batch.column("text")):
                cells = _cells(at, PASSAGE)
                found[BUCKETS] += len(cells) - 1
                owner = np.repeat(np.arange(len(cells) - 1), np.diff(cells))
                found[:BUCKETS] += np.bincount(np.unique(owner * BUCKETS + _buckets(hashes)) % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["bucket", "n"])
        give_back()

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return Latent(_idf(found), None)


def _idf(found: np.ndarray) -> np.ndarray:
    return (np.log((1 + found[BUCKETS]) / (1 + found[:BUCKETS])) + 0.1).astype(np.float32)


def fit(docs: DataFrame, text_col: str = "text", seed: int = 0) -> Latent:
    """Randomised SVD (one pass, Nystroem form; Halko et al., 2011) of the TF-IDF matrix of all passages of
    all texts: counts, each passage's scaled to length one, times the IDF. As the IDF scales whole columns, it
    is applied to the sums afterwards and the texts are read once. Tasks send a matrix of ``BUCKETS`` by
    ``COLUMNS`` sums each, and the driver gets one such matrix. Null and empty texts have no passages."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    random = np.linalg.qr(np.random.default_rng(seed).normal(size=(BUCKETS, COLUMNS)))[0]
    padded = _padded(random.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros((BUCKETS + 1, COLUMNS), np.float32)
        found = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, _, hashes, at in _scan(batch.column("text")):
                cells, bucket = _cells(at, PASSAGE), _buckets(hashes)
                found[BUCKETS] += len(cells) - 1
                for i in range(0, len(cells) - 1, DENSE):
                    ends = cells[i : i + DENSE + 1]
                    n, own = len(ends) - 1, bucket[ends[0] : ends[-1]]
                    owner = np.repeat(np.arange(n), np.diff(ends))
                    rows = np.bincount(owner * BUCKETS + own, minlength=n * BUCKETS).astype(np.float32).reshape(n, BUCKETS)
                    found[:BUCKETS] += np.count_nonzero(rows, axis=0)
                    scale = 1 / np.einsum("ij,ij->i", rows, rows)[:, None]
                    y[:BUCKETS] += rows.T @ (_sums(padded, own, ends[:-1] - ends[0], ends[1:] - ends[0]) * scale)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some]), *(pa.array(y[some, k]) for k in range(COLUMNS))], names=["bucket", "n", *names])
        give_back()

    names = [f"y{k}" for k in range(COLUMNS)]
    parts = texts.mapInArrow(run, "bucket long, n long, " + ", ".join(f"{n} float" for n in names))
    summed = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).toPandas()
    place = summed["bucket"].to_numpy(np.int64)
    found, y = np.zeros(BUCKETS + 1, np.int64), np.zeros((BUCKETS + 1, COLUMNS))
    found[place], y[place] = summed["n"].to_numpy(np.int64), summed[names].to_numpy(np.float64)
    idf = np.log((1 + found[BUCKETS]) / (1 + found[:BUCKETS])) + 0.1
    omega, lower = np.linalg.qr(random / idf[:, None])
    y = np.linalg.solve(lower.T, (y[:BUCKETS] * idf[:, None]).T).T
    shift = 1e-6 * max(1e-6, np.linalg.norm(y))
    y += shift * omega
    small = omega.T @ y
    lower = np.linalg.cholesky((small + small.T) / 2 + shift * np.eye(COLUMNS))
    left, size, _ = np.linalg.svd(np.linalg.solve(lower, y.T).T, full_matrices=False)
    return Latent(idf.astype(np.float32), (left[:, :RANK] / np.maximum(size[:RANK], size[0] * 1e-4)).astype(np.float32))


@dataclass
class Passages:
    """Benchmark passages: ids of their items, word hashes, bounds, and which words are the answer."""

    items: list
    hashes: np.ndarray
    at: np.ndarray
    answer: np.ndarray


def benchmark_passages(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", key: int = 0) -> Iterator[Passages]:
    """The benchmark in blocks of ``AT_ONCE`` passages of up to ``PASSAGE`` words; a longer item is several,
    of which the last is its last ``PASSAGE`` words where fewer than ``SHORT`` would be left for it.
    The answer of a passage is its last sentence, or its last quarter where that is one sentence.
    Null and empty texts have no passages. Documents that are searched for them are hashed under the same ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, offsets in textscan.byte_chunks(batch.column("text")):
                starts, ends, at = textscan.words(values, offsets, "alnum")
                hashes, cells = _word_hashes(values, starts, ends, key), _cells(at, PASSAGE)
                stops = np.append(0, np.cumsum(np.isin(values, np.frombuffer(b".!?\n", np.uint8))))
                sentence = stops[starts]
                rows = np.searchsorted(at, cells[:-1], "right") - 1
                begin, end = cells[:-1], cells[1:]
                begin = np.where((end - begin < SHORT) & (begin > at[rows]), end - PASSAGE, begin)
                tails = []
                for i, j in zip(begin, end):
                    own = np.flatnonzero(sentence[i:j] == sentence[j - 1])
                    first = int(own[0]) if len(own) else 0
                    tails.append(first if 0 < first <= (j - i) - min(3, j - i) else int((j - i) * 3 // 4))
                ids = batch.column("item_id").slice(a, b - a).take(pa.array(rows))
                words = pa.array([hashes[i:j].tobytes() for i, j in zip(begin, end)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(tails, pa.int32())], names=["item_id", "words", "tail"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"item_id {kind}, words binary, tail int")
    held: list = []

    def block() -> Passages:
        parts = [np.frombuffer(r.words, u64) for r in held]
        sizes = np.array([len(p) for p in parts])
        answer = np.concatenate([np.arange(n) >= r.tail for n, r in zip(sizes, held)])
        return Passages([r.item_id for r in held], np.concatenate(parts), np.append(0, np.cumsum(sizes)), answer)

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == AT_ONCE:
            yield block()
            held = []
    if held:
        yield block()


def common_length(masks: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences, bit-parallel over all rows: ``masks[r, j]`` has the places of
    passage ``r`` that hold the ``j``-th word of its window."""
    v = np.full(len(masks), np.iinfo(u64).max, u64)
    for j in range(masks.shape[1]):
        u = v & masks[:, j]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


class Group:
    """Some passages of the benchmark, with what finding them in pieces of the documents needs."""

    def __init__(self, latent: Latent, vectors: np.ndarray | None, hashes: np.ndarray, at: np.ndarray, answer: np.ndarray):
        sizes = np.diff(at)
        self.vectors, self.latent, self.at, self.sizes, self.bucket = vectors, latent, at, sizes, _buckets(hashes)
        #: a window of so many blocks holds a passage wherever it begins
        self.blocks = -(-(sizes + BLOCK - 1) // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(owner)) - at[owner]
        self.words, word = np.unique(hashes, return_inverse=True)
        key = owner * len(self.words) + word
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        bit = u64(1) << place.astype(u64)
        #: the places of a word in a passage, by the number of the two; 0 where the passage lacks it, and words
        #: that no passage holds have the last row
        self.masks = np.append(u64(0), np.bitwise_or.reduceat(bit[order], heads))
        self.number = np.zeros((len(self.words) + 1, len(sizes)), np.int32)
        self.number[word[order][heads], owner[order][heads]] = np.arange(1, len(self.masks))
        self.answers = np.bitwise_or.reduceat(np.where(answer, bit, u64(0)), at[:-1])
        self.need = np.where(sizes < SHORT, sizes, np.ceil(SHARE * sizes)).astype(np.int64)
        self.part = np.where(sizes < SHORT, sizes, np.ceil(PART * sizes)).astype(np.int64)
        self.told = np.ceil(ANSWER * np.bitwise_count(self.answers)).astype(np.int64)
        #: the IDF of each place, as shares of the passage's
        self.weight = np.zeros((len(sizes), PASSAGE))
        self.weight[owner, place] = latent.idf[_buckets(hashes)]
        self.weight /= np.maximum(self.weight.sum(axis=1), 1e-12)[:, None]
        #: Any words of a passage may be left out of a count of those that a window has, if the passage's places
        #: of them are taken off what the count must reach. Those are left out that windows are likely to have
        #: more often than the passage.
        window = BLOCK * (self.blocks + 2)
        count = np.bitwise_count(self.masks[self.number])
        often = LOCAL * np.append(latent.rates(self.words), 0)[:, None] * window > count
        #: 1 for the words of a passage that are counted
        self.held = ((self.number > 0) & ~often).astype(np.uint8)
        self.least = np.maximum(0, np.minimum(self.need, self.part) - (count * often).sum(axis=0, dtype=np.int64))

    def places(self, word: np.ndarray, begin: np.ndarray, stop: np.ndarray, span: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """The places of passages whose words occur in spans of words, of pairs of a span and a passage."""
        out = np.zeros(len(span), u64)
        for j in range(int((stop - begin).max(initial=0))):
            own = np.where(begin + j < stop, word[np.minimum(begin + j, len(word) - 1)], len(self.words)) * self.number.shape[1]
            out |= self.masks.take(self.number.take(own.take(span) + passage, mode="clip"), mode="clip")
        return out

    def known(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[place] == hashes, place, len(self.words))

    def kinship(self, passage: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Latent cosines of some places of passages, bits of ``present``, with all of them; other words of a window do not
        count. 1 for passages that have no direction in the latent space."""
        out = np.ones(len(passage))
        for a in range(0, len(out), 256):
            mine, bits = passage[a : a + 256], np.ascontiguousarray(present[a : a + 256])
            place = self.at[mine][:, None] + np.arange(PASSAGE)
            bucket = np.where(place < self.at[mine + 1][:, None], self.bucket[np.minimum(place, len(self.bucket) - 1)], BUCKETS)
            vectors = self.latent.plain[bucket].astype(np.float64)
            whole = vectors.sum(axis=1)
            some = np.einsum("ij,ijk->ik", np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64), vectors)
            size = np.linalg.norm(whole, axis=1)
            cosine = np.einsum("ij,ij->i", some, whole) / np.maximum(size * np.linalg.norm(some, axis=1), 1e-12)
            out[a : a + 256] = np.where(size > 1e-9, cosine, 1)
        return out

    def leaks(self, word: np.ndarray, begin: np.ndarray, stop: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which candidates, passages and spans of words, are leaks, and their words in common."""
        place = begin[:, None] + np.arange(int((stop - begin).max()))
        own = np.where(place < stop[:, None], word[np.minimum(place, len(word) - 1)], len(self.words))
        masks = self.masks[self.number[own, passage[:, None]]]
        length, answer = common_length(masks), self.answers[passage]
        told = common_length(masks & answer[:, None]) >= self.told[passage]
        reworded = np.flatnonzero((length < self.need[passage]) & (length >= self.part[passage]) & told)
        present = np.bitwise_or.reduce(masks[reworded], axis=1)
        held = np.unpackbits(present.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * self.weight[passage[reworded]]
        leak = length >= self.need[passage]
        leak[reworded[held.sum(axis=1) >= WEIGHT]] = True
        if self.latent.basis is not None:
            partly = np.flatnonzero(leak & (length < self.sizes[passage]))
            leak[partly] = self.kinship(passage[partly], np.bitwise_or.reduce(masks[partly], axis=1)) >= LATENT
        return np.flatnonzero(leak), length[leak]


class Matcher:
    """Finds the passages of one block of the benchmark in pieces of the documents."""

    def __init__(self, latent: Latent, block: Passages, cosine: float | None = None):
        self.latent, self.cosine = latent, cosine
        self.size = np.diff(block.at)
        vectors = None if latent.basis is None else latent.spans(block.hashes, block.at[:-1], block.at[1:])
        self.groups = []
        for a in range(0, len(self.size), GROUP):
            at = block.at[a : a + GROUP + 1]
            own = slice(at[0], at[-1])
            self.groups.append((a, Group(latent, None if vectors is None else vectors[a : a + GROUP], block.hashes[own], at - at[0], block.answer[own])))

    def find(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, passage, words in common, cosine)`` of the leaks in rows of words."""
        cells = _cells(at, BLOCK)
        n = len(cells) - 1
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        if not n:
            return found[0]
        row = np.searchsorted(at, cells[:-1], "right") - 1
        first, end = np.searchsorted(cells, at[row]), np.searchsorted(cells, at[row + 1])
        for offset, group in self.groups:
            word = group.known(hashes)
            for m in np.unique(group.blocks):
                mine = np.flatnonzero(group.blocks == m)
                table = np.ascontiguousarray(group.held[:, mine])
                need, part, told = (x[mine].astype(np.uint8) for x in (group.need, group.part, group.told))
                least = group.least[mine].astype(np.uint16)
                for a in range(0, n, 1 << 13):
                    i = np.arange(a, min(n, a + (1 << 13)))
                    start = max(0, a - 1)
                    near = cells[start : i[-1] + m + 2]
                    held = _sums(table, word, near[:-1], near[1:])
                    # a window is read with one more block on either side, and no subsequence is longer
                    # than the number of its words that the passage holds
                    low, high = np.maximum(i - 1, first[i]), np.minimum(i + m + 1, end[i])  # so at most 7 * 16 words
                    before = np.zeros((len(held) + 1, len(mine)), np.uint16)  # modulo 2^16, over any span's count
                    np.cumsum(held, axis=0, out=before[1:])
                    common = before[high - start] - before[low - start]
                    p, q = np.nonzero(common >= least)
                    # nor is one longer than the number of the passage's places whose words occur
                    spans = [np.minimum(low[p] + k, high[p] - 1) - start for k in range(int(m) + 2)]
                    wanted, seen = np.zeros(held.shape, bool), np.zeros(held.shape, u64)
                    for x in spans:
                        wanted[x, q] = True
                    x, y = np.nonzero(wanted)
                    seen[x, y] = group.places(word, near[:-1], near[1:], x, mine[y])
                    places = np.zeros(len(p), u64)
                    for x in spans:
                        places |= seen[x, q]
                    known, answered = np.bitwise_count(places), np.bitwise_count(places & group.answers[mine[q]])
                    likely = (known >= need[q]) | (known >= part[q]) & (answered >= told[q])
                    p, q = p[likely], q[likely]
                    for k in range(0, len(p), 1 << 14):
                        x, y = p[k : k + (1 << 14)], q[k : k + (1 << 14)]
                        some, length = group.leaks(word, cells[low[x]], cells[high[x]], mine[y])
                        x, y = i[x[some]], mine[y[some]]
                        score = np.zeros(len(x))
                        if group.vectors is not None:
                            score = (self.latent.spans(hashes, cells[x], cells[np.minimum(x + m, end[x])]) * group.vectors[y]).sum(axis=1)
                        ok = slice(None) if self.cosine is None else score >= self.cosine
                        found.append((row[x[ok]], offset + y[ok], length[ok], score[ok]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _searched(batches: Iterator[pa.RecordBatch], text: str, name: str | None, latent: Latent, blocks: list[Passages], cosine: float | None, key: int) -> Iterator[tuple]:
    """``(ids, rows, (block, sizes of its passages, row, passage, words in common, cosine))`` for pieces of batches
    and, for each piece, all blocks of passages in turn. Where there are several, a block is made ready for
    ``AHEAD`` bytes of texts at once."""
    ready = {0: Matcher(latent, blocks[0], cosine)} if len(blocks) == 1 else {}
    held, size = [], 0

    def search() -> Iterator[tuple]:
        found: list[list] = [[] for _ in held]
        for k, block in enumerate(blocks):
            matcher = ready.get(k) or Matcher(latent, block, cosine)
            for mine, (_, hashes, at) in zip(found, held):
                mine.append((block, matcher.size, *matcher.find(hashes, at)))
        for mine, (part, _, _) in zip(found, held):
            ids = part.column(name) if name else None
            for one in mine:
                yield ids, part, one

    for batch in batches:
        for a, b, hashes, at in _scan(batch.column(text), key):
            held.append((batch.slice(a, b - a), hashes, at))
            size += 8 * len(hashes)
            if ready or size >= AHEAD:
                yield from search()
                held, size = [], 0
    if held:
        yield from search()


def find_leaks(docs: DataFrame, benchmark: DataFrame, latent: Latent | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float | None = None) -> DataFrame:
    """``(doc_id, item_id, words_in_common, share, cosine)``: the benchmark items that a document holds.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A document holds an
    item if a window of it has 3/4 of the words of one of the item's passages (64 words at most) in order,
    or half of them, 3/4 of the passage's answer, and words that hold 2/5 of the passage's IDF, and if, where the passage
    is not whole, those of its words have a latent cosine of 0.3 with it; passages under 8 words must be whole. The best window counts. No window is passed over, unless ``cosine`` is given, which leaks then have at least. Null texts are empty and hold nothing; empty tables give no rows; rows that repeat an id are
    one document; a null id is an id. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    latent, key = latent or fit(docs, text_col), textscan.secret_key()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, words_in_common long, share double, cosine double"

    def scan(blocks: list[Passages]) -> Callable:
        item_type = pa.array([x for block in blocks for x in block.items]).type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, _, (block, size, row, passage, length, score) in _searched(batches, "text", "doc_id", latent, blocks, cosine, key):
                items = pa.array([block.items[k] for k in passage.tolist()], item_type)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), items, pa.array(length), pa.array(length / size[passage]), pa.array(score.astype(np.float64))], names=["doc_id", "item_id", "words_in_common", "share", "cosine"])
            give_back()

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for blocks in itertools.batched(benchmark_passages(benchmark, item_col, item_text_col, key), SCAN):
        out = out.unionByName(rows.mapInArrow(scan(list(blocks)), schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("words_in_common").alias("words_in_common"), F.max("share").alias("share"), F.max("cosine").alias("cosine"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, latent: Latent | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; see ``find_leaks``, which goes by the
    same latent space. One that is given without a basis (``weights``) leaves that step out."""
    bound_batches(docs.sparkSession)
    latent, key = latent or fit(docs, text_col), textscan.secret_key()

    def scan(blocks: list[Passages]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.RecordBatch | None = None
            for _, part, (_, _, row, *_) in _searched(batches, text_col, None, latent, blocks, None, key):
                if part is not held:
                    if held is not None:
                        yield held.filter(pa.array(clean))
                    held, clean = part, np.ones(part.num_rows, bool)
                clean[row] = False
            if held is not None:
                yield held.filter(pa.array(clean))
            give_back()

        return run

    out = docs
    for blocks in itertools.batched(benchmark_passages(benchmark, item_col, item_text_col, key), SCAN):
        out = out.mapInArrow(scan(list(blocks)), docs.schema)
    return out
