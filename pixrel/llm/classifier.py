"""Quality classifier: n-gram indicators scaled by class log-count ratios, a linear hinge loss fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixrel.llm.common import HASH, LOWER, map_arrow, mix, texts, tidy, word_bounds

#: Labelled documents that the model is fitted on at most: those of the lowest hashes of their ids. With 12,000 of them
#: held-out documents of the check tables are told apart no better (AUC 1.0000 on 4,061 documents with either).
FIT_DOCS = 8_000
#: Indicator spaces: byte trigrams, words, and word shapes with their share of the text.
TRIGRAMS, WORDS, SHAPES = 1 << 17, 1 << 16, 1 << 14
SIZE = TRIGRAMS + WORDS + SHAPES
SMOOTH, COST, EPOCHS = 1.0, 1.0, 12
#: Labelled documents that an n-gram must be in to have a weight.
MIN_DOCS = 3
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1  # upper case
_CLASS[48:58] = 2  # digit
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4  # punctuation and symbols
_CLASS[97:123] = 8  # lower case
_CLASS[128:] = 16


def indicators(text: bytes) -> np.ndarray:
    """Sorted ids of the n-grams that a text has, each once; an empty text has none."""
    buf = np.frombuffer(text, np.uint8)
    flags = np.zeros(SIZE, bool)
    if len(buf) >= 3:
        b = buf.astype(np.uint64)
        tri = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        flags[((tri * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)] = True
    start, end = word_bounds(buf)
    if len(start):
        low = np.frombuffer(text.translate(LOWER), np.uint8)
        h = HASH.ranges(HASH.prefix(low), start, end)
        flags[TRIGRAMS + (h >> np.uint64(48)).astype(np.int64)] = True
        cls = np.bitwise_or.reduceat(_CLASS[buf], start)  # white space between words has no class
        shape = cls.astype(np.int64) * 2
        shape[1:] += h[1:] == h[:-1]
        n = len(shape)
        codes = [shape, 256 + ((shape[:-1] * 131 + shape[1:]) % 1792)] if n > 1 else [shape]
        for c in codes:
            found, count = np.unique(c, return_counts=True)
            share = np.minimum(7, np.maximum(0, np.log2(count * 128 / n))).astype(np.int64)
            flags[TRIGRAMS + WORDS + (found * 8 + share) % SHAPES] = True
    return np.flatnonzero(flags).astype(np.int32)


@dataclass
class Model:
    """Margin of a text: bias plus the weights of its indicators over the length of its scaled vector, as in fitting.

    squares are those of the indicators' log-count ratios, whose sum is the squared length. The score is a sigmoid of
    the margin, calibrated on documents apart.
    """

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        length = max(float(self.squares[ids].sum(dtype=np.float64)) ** 0.5, 1e-9)
        return self.bias + float(self.weights[ids].sum(dtype=np.float64)) / length

    def score(self, ids: np.ndarray) -> float:
        z = self.slope * self.margin(ids) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: indicator ids; labels 0 or 1. With one class alone, or no row, every text gets the share of label 1 (1/2)."""
    n = len(rows)
    if not n or labels.min() == labels.max():
        p = (labels.sum() + 1) / (n + 2)
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    apart = np.arange(n) % 5 == 4  # for the calibration
    if len(set(labels[~apart])) < 2 or not apart.any():
        apart = np.zeros(n, bool)
    train = np.flatnonzero(~apart)
    counts = np.zeros((2, SIZE))
    for i in train:
        counts[labels[i], rows[i]] += 1
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[counts.sum(0) < MIN_DOCS] = 0
    # dual coordinate descent for the L1 hinge loss, the bias as a constant feature; texts scaled to unit length
    w, b = np.zeros(SIZE), 0.0
    alpha = np.zeros(n)
    norms = np.array([max(float(np.linalg.norm(ratio[r])), 1e-9) for r in rows])
    y = np.where(labels == 1, 1.0, -1.0)
    cost = COST * np.where(labels == 1, 1.0, max(1.0, float((labels == 1).sum() / max(1, (labels == 0).sum()))) ** 0.5)
    rng = np.random.RandomState(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            r = rows[i]
            v = ratio[r] / norms[i]  # not kept: the driver holds the ids alone
            g = y[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), cost[i])  # squared length 1, and 1 of the bias
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[r] += step * v
                b += step
                alpha[i] = new
    model = Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(b), 1.0, 0.0)
    held = np.flatnonzero(apart) if apart.any() else train
    model.slope, model.shift = calibrate(np.array([model.margin(rows[i]) for i in held]), labels[held])
    return model


def calibrate(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Sigmoid by Newton steps on the log loss with smoothed targets."""
    pos, neg = int((labels == 1).sum()), int((labels == 0).sum())
    t = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        g = np.array([((p - t) * z).sum() + 1e-6 * a, (p - t).sum()])
        h = p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        a, c = a - step[0] * min(1.0, 5 / (np.abs(step).max() + 1e-9)), c - step[1] * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(c)


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", bound: int = FIT_DOCS) -> Model:
    """Fit on at most bound labelled documents outside the held-out fifth, those of the lowest hashes of their ids.

    Labels of null ids, and null labels, are left out; of several labels of an id the highest counts, of several texts
    of an id the first in order, null as empty. Without labels, documents or their ids in common, the model scores
    every text alike. Columns other than text, id and label are not read.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(bound)  # broadcast below: bounded by the parameter
    d = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")
    d = d.groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__label").alias("__label"))  # a row for each id: bound at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), pa.array([indicators(x).tobytes() for x in texts(batch, "__text")], pa.binary())], names=["id", "label", "ids"])

    got = map_arrow(d.select("__id", "__label", "__text"), run, "id long, label int, ids binary").toArrow()
    keys = got["id"].to_numpy()
    order = np.lexsort((keys, mix(keys.view(np.uint64)))) if len(keys) else []
    ids, marks = got["ids"].to_pylist(), got["label"].to_numpy()
    del got
    model = fit([np.frombuffer(ids[i], np.int32) for i in order], marks[order].astype(np.int64) if len(keys) else np.array([], np.int64))
    del ids
    tidy()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """doc_id, kept columns, score (0 to 1), predicted (1 where score >= THRESHOLD). Null texts score as empty ones.

    names tells the last two apart from kept columns of the same name, which is an error. Rows are independent: repeated
    ids and rows are scored each, ties are alike, an empty table gives no row. A text is scored whole, in one task, with
    some 60 bytes of memory for each of its bytes.
    """
    if clash := {*names} & {id_col, *keep}:
        raise ValueError(f"columns {sorted(clash)} are kept: choose other names")
    out = list(dict.fromkeys([id_col, *keep]))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores = [m.score(indicators(x)) for x in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=[*out, *names])

    return map_arrow(docs.select(*dict.fromkeys([*out, text])), run, ", ".join([*fields, f"`{names[0]}` double", f"`{names[1]}` int"]))
