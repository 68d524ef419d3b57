"""Quality scores by attention-based multiple-instance learning over all passages of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm import textscan
from twinlake.llm.wordtable import give_back
from twinlake.session import bound_batches

PASSAGE = 64
#: The classifier is fitted on at most this many labelled documents, those with the smallest hashes.
TRAIN_DOCS = 3000
FOLDS = 5
LEAST_SCORE = 0.3
HIDDEN, GATE, STEPS, RATE = 16, 8, 300, 0.02

#: Byte classes that a passage is described by.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",;:", "!", "?", "|", "#%&*$@^~=+", "\"'`", "()[]{}<>", "-_/\\"]
_TABLE = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES):
    _TABLE[[ord(c) for c in _chars]] = _k
_TABLE[128:] = len(CLASSES) + 1
KINDS = len(CLASSES) + 2
FEATURES = KINDS + 5


def passages(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature row per passage of ``PASSAGE`` words, and per text where its passages begin. A text
    without words is one passage."""
    starts, ends, at = textscan.words(values, offsets, "blank")
    words = np.diff(at)
    counts = np.maximum(1, -(-words // PASSAGE))
    bounds = np.append(0, np.cumsum(counts))
    n = int(bounds[-1])
    owner = np.repeat(np.arange(len(words)), counts)
    part = np.arange(n) - bounds[owner]
    first = at[owner] + part * PASSAGE
    begin = np.where(part == 0, offsets[owner], np.append(starts, 0)[np.minimum(first, len(starts))])
    size = np.diff(np.append(begin, len(values)))
    table = np.bincount(np.repeat(np.arange(n) * KINDS, size) + _TABLE[values], minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    last = np.minimum(first + PASSAGE, at[owner + 1])
    length = np.maximum(1, last - first)
    hashes = textscan.lower_hashes(values, starts, ends)
    out = np.zeros((n, FEATURES))
    out[:, :KINDS] = table / np.maximum(1, size)[:, None]

    def mean(x: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(x))
        return (sums[last] - sums[first]) / length

    out[:, KINDS] = mean(ends - starts) / 10
    for k, lag in enumerate((1, 2)):
        same = np.zeros(len(hashes))
        same[lag:] = hashes[lag:] == hashes[:-lag]
        same[np.concatenate([at[:-1][words > j] + j for j in range(lag)])] = 0  # a text's first words follow no word of it
        out[:, KINDS + 1 + k] = mean(same)
    tail = _TABLE[values[ends - 1]] >= 3 if len(ends) else np.zeros(0)
    out[:, KINDS + 3] = mean(tail)
    out[:, KINDS + 4] = np.log1p(np.where(last > first, last - first, 0)) / 4
    return out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """tanh encoder, gated attention (Ilse et al., 2018) and a logistic score of the weighted passage."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, heads = self.p, bounds[:-1]
        counts = np.diff(bounds)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        e = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
        s = (v * u) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, heads), counts))
        a = s / np.repeat(np.add.reduceat(s, heads), counts)
        z = np.add.reduceat(a[:, None] * e, heads, axis=0)
        return {"x": x, "e": e, "v": v, "u": u, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["c0"])}

    def gradients(self, f: dict[str, np.ndarray], bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, heads, counts = self.p, bounds[:-1], np.diff(bounds)
        d = (f["score"] - y) * weight
        g = {"c": f["z"].T @ d, "c0": d.sum(keepdims=True)}
        dz = np.repeat(d[:, None] * p["c"], counts, axis=0)
        da = (dz * f["e"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, heads), counts))
        g["w"] = (f["v"] * f["u"]).T @ ds
        dv = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["e"].T @ dv, f["e"].T @ du
        de = f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        de *= 1 - f["e"] ** 2
        g["W"], g["b"] = f["x"].T @ de, de.sum(axis=0)
        return g


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 0) -> Model:
    """Adam on the mean logistic loss."""
    rng = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "c0": (1,)}
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, {k: (rng.normal(0, 0.3, s) * (k not in ("b", "c0"))).astype(x.dtype) for k, s in shape.items()})
    weight = np.full(len(y), 1 / len(y))
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    m, v = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}
    for t in range(1, steps + 1):
        g = model.gradients(model.forward(x, bounds), bounds, y, weight)
        for k in shape:
            d = g[k] + 1e-4 * model.p[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            model.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
    return model


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``TRAIN_DOCS`` labelled documents outside the held-out fifth, all passages of each.

    Rows without an id, a label of 0 or 1, or with an id that is labelled both ways teach nothing. Of rows that
    repeat an id, the one with the smallest hash of its text teaches. With no labelled rows at all, empty tables
    among them, every text scores one half.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y")).where("label_id is not null and y in (0, 1)")
    one = known.groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    chosen = one.where(~is_held_out("label_id")).orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_DOCS).select("label_id", "y")
    texts = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, offsets in textscan.byte_chunks(batch.column("text")):
                x, bounds = passages(values, offsets)
                rows = []
                for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    rows.append(x[i:j].astype(np.float32).tobytes())
                same = [batch.column(c).slice(a, b - a) for c in ("label_id", "y", "print")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(rows, pa.binary())], names=["label_id", "y", "print", "x"])
        give_back()

    kind = texts.schema["label_id"].dataType.simpleString()
    # at most TRAIN_DOCS ids are broadcast
    rows = texts.join(F.broadcast(chosen), "label_id").select("label_id", "y", F.xxhash64("text").alias("print"), "text").mapInArrow(describe, f"label_id {kind}, y int, print long, x binary")
    rows = sorted(rows.groupBy("label_id").agg(F.min(F.struct("print", "y", "x")).alias("r")).select("label_id", "r.y", "r.x").collect(), key=lambda r: r.label_id)
    if len({r.y for r in rows}) < 2:
        zero = {"W": np.zeros((FEATURES, 1)), "b": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1)}
        constant = np.zeros(1) if not rows else np.array([4.0 if rows[0].y else -4.0])
        return Model(np.zeros(FEATURES), np.ones(FEATURES), zero | {"c0": constant})
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])), np.array([r.y for r in rows], np.float64))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``: every passage of every whole
    text is encoded, and the attention-weighted passage scored. Null texts are empty; empty texts have a
    score too. Null and repeated ids and repeated rows are kept; other columns are not read; an empty table
    gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, offsets in textscan.byte_chunks(batch.column("text")):
                x, bounds = passages(values, offsets)
                score = model.forward(x, bounds)["score"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(score)], names=["doc_id", "held_out", "score"])
        give_back()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.select("*", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, offsets in textscan.byte_chunks(batch.column(text_col)):
                x, bounds = passages(values, offsets)
                yield batch.slice(a, b - a).filter(pa.array(model.forward(x, bounds)["score"] >= LEAST_SCORE))
        give_back()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
