"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised bit overlap."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixrel.llm.common import HASH, map_arrow, n_parts, texts
from pixrel.llm.token_files import range_buckets

#: Bytes of a window; windows that compete; wins that select a window; bits of a filter, its features and hashes.
WINDOW, RIVALS, WINS = 64, 64, 16
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Share of the possible overlap beyond chance that counts as none (unrelated texts share short runs).
CUTOFF = 0.08

_C = np.arange(WINDOW + 1, dtype=np.float64)
#: c log2 c for counts of a byte in a window.
CLOGC = np.concatenate([[0.0], _C[1:] * np.log2(_C[1:])])
#: Gain of c log2 c, in integer millionths, when a count grows by one: sums of integers don't depend on where they start.
GAIN = np.rint(1e6 * np.diff(CLOGC)).astype(np.int64)


def window_entropy(buf: np.ndarray) -> np.ndarray:
    """Entropy of each window of WINDOW bytes in steps of 1/1000 of its largest value, slid by counts of entering and leaving bytes."""
    n = len(buf)
    order = np.argsort(buf, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    keys = buf[order].astype(np.int64) * (n + WINDOW) + order
    own = buf.astype(np.int64) * (n + WINDOW)
    at = np.arange(n)
    # of the byte at i: copies in the WINDOW - 1 bytes after it (as it leaves), and before it (as it enters)
    after = (np.searchsorted(keys, (own + at + WINDOW)[order])[rank] - rank - 1).clip(0, WINDOW - 1)
    before = (rank - np.searchsorted(keys, (own + np.maximum(at - WINDOW + 1, 0))[order])[rank]).clip(0, WINDOW - 1)
    enter = np.cumsum(GAIN[before])
    leave = np.cumsum(GAIN[after])
    total = enter[WINDOW - 1 :].copy()
    total[1:] -= leave[: n - WINDOW]
    return (1000 * (1 - total / (1e6 * CLOGC[WINDOW]))).clip(0, 1000).astype(np.int16)


def rarity(entropy: np.ndarray) -> np.ndarray:
    """Rank of a window by how improbable its entropy is: the extremes (runs, and codes near random) are common in files of
    any kind and rank last, then values count as rarer the farther they lie from the bulk at about 2/3 of the scale."""
    far = np.abs(entropy.astype(np.int32) - 640)
    return np.where((entropy < 100) | (entropy > 990), 2000, 1000 - far).astype(np.int32)


def popular(rank: np.ndarray) -> np.ndarray:
    """Windows that have the lowest rank (leftmost of equals) of at least WINS runs of RIVALS neighbours."""
    n = len(rank)
    if n <= RIVALS:
        return np.array([int(np.argmin(rank))])
    key = rank.astype(np.int64) * (n + 1) + np.arange(n)
    pad = -(-n // RIVALS) * RIVALS
    full = np.full(pad, np.iinfo(np.int64).max)
    full[:n] = key
    blocks = full.reshape(-1, RIVALS)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(down[: n - RIVALS + 1], up[RIVALS - 1 : n]) % (n + 1)
    first = np.flatnonzero(np.diff(low, prepend=-1))
    wins = np.diff(first, append=len(low))
    chosen = low[first[wins >= WINS]]
    return chosen if len(chosen) else low[:1]  # in text of a short period no window wins often


class Text:
    """A text's windows: their entropy and hashes, from which texts that share its start or end can be made."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.buf = np.frombuffer(raw, np.uint8)
        self.entropy = window_entropy(self.buf) if len(raw) >= WINDOW else np.empty(0, np.int16)


def features(raw: bytes, entropy: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows in order; a text shorter than a window is one feature, an empty one has none."""
    if not raw:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(raw, np.uint8)
    prefix = HASH.prefix(buf)
    if len(raw) < WINDOW:
        return HASH.ranges(prefix, np.array([0]), np.array([len(raw)]))
    at = popular(rarity(entropy))
    hashes = HASH.ranges(prefix, at, at + WINDOW)
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def spliced_entropy(first: Text, cut: int, second: Text, take: int, raw: bytes) -> np.ndarray:
    """Entropy of the windows of first[:cut] + second[:take]: only those across the joint are computed."""
    if len(raw) < WINDOW:
        return np.empty(0, np.int16)
    a, b = max(0, cut - WINDOW + 1), max(0, take - WINDOW + 1)
    left, right = first.entropy[:a], second.entropy[:b]
    lo, hi = len(left), len(raw) - WINDOW + 1 - len(right)
    middle = window_entropy(np.frombuffer(raw, np.uint8)[lo : hi + WINDOW - 1]) if hi > lo else np.empty(0, np.int16)
    return np.concatenate([left, middle, right])


def chain(hashes: np.ndarray) -> np.ndarray:
    """Rows of filter bits: each takes FILTER_FEATURES features in order, spread evenly so that the last is not sparse."""
    if not len(hashes):
        return np.zeros((0, FILTER_BITS), bool)
    k = -(-len(hashes) // FILTER_FEATURES)
    out = np.zeros((k, FILTER_BITS), bool)
    row = np.arange(len(hashes)) * k // len(hashes)
    for i in range(HASHES):
        out[row, ((hashes >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best overlap beyond chance in the other, averaged; equal chains 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    ones_a, ones_b = a.sum(1), b.sum(1)
    both = a.astype(np.float32) @ b.astype(np.float32).T
    most = np.minimum(ones_a[:, None], ones_b[None, :])
    chance = ones_a[:, None] * ones_b[None, :] / FILTER_BITS
    floor = chance + CUTOFF * (most - chance)
    score = np.where(most > floor, (both - floor) / np.maximum(most - floor, 1e-9), both >= most)
    # filters of fewer features must not claim a whole longer text
    size = np.minimum(1.0, np.maximum(ones_a.sum(), 1) / np.maximum(ones_b.sum(), 1)) if len(a) == len(b) == 1 else 1.0
    return float(np.clip(score.clip(0, 1).max(axis=1).mean() * max(size, 0.5), 0, 1)) if not np.array_equal(a, b) else 1.0


def hexed(bits: np.ndarray) -> str:
    return np.packbits(bits, axis=1).tobytes().hex()


def cut_bytes(raw: bytes, chars: int) -> int:
    """Bytes of the first chars code points."""
    if raw.isascii():
        return min(chars, len(raw))
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return int(starts[chars]) if chars < len(starts) else len(raw)


def compare(doc: Text, bits: np.ndarray, after: Text, bits_after: np.ndarray) -> dict:
    n = len(doc.raw.decode()) if not doc.raw.isascii() else len(doc.raw)
    cut, take = cut_bytes(doc.raw, n - n // 2), cut_bytes(after.raw, n // 2)
    raw = doc.raw[:cut] + after.raw[:take]
    edited = chain(features(raw, spliced_entropy(doc, cut, after, take, raw)))
    return {"n_chars": n, "edited_sha256": hashlib.sha256(raw).hexdigest(), "fingerprint": hexed(bits), "edited_fingerprint": hexed(edited), "near_edited": likeness(bits, edited), "near_next": likeness(bits, bits_after)}


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next by ascending doc_id, after the last the first; nulls come first, equal ids are
    ordered by text. Texts cross the network once, in ranges of ids; each range also gets a copy of the first
    document of the next one, so that no range waits for another. Null texts are empty: no feature, no fingerprint,
    likeness 1 to each other and 0 to the rest. A single document is its own next one.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    borders = range_buckets(d, "doc_id", n_parts(d.sparkSession))

    def where(doc_id: int | None) -> int:
        return 0 if doc_id is None else bisect.bisect_right(borders, doc_id)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int | None] = {}
        for batch in batches:
            for x in batch.column(0).to_pylist():
                r = where(x)
                if r not in low or (low[r] is not None and (x is None or x < low[r])):
                    low[r] = x
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.int64())], names=["r", "doc_id"])

    # the first id of each range: a row for each range and task
    first: dict[int, int | None] = {}
    for r, x in map_arrow(d.select("doc_id"), heads, "r int, doc_id long").groupBy("r").agg(F.when(F.count("doc_id") == F.count(F.lit(1)), F.min("doc_id"))).collect():
        first[r] = x
    filled = sorted(first)
    goes = {first[r]: filled[i - 1] for i, r in enumerate(filled)}  # the first document of a range also ends the range before

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            again = [i for i, x in enumerate(ids) if x in goes]
            rows = batch.take(pa.array([*range(len(ids)), *again], pa.int64()))
            ranges = [*map(where, ids), *(goes[ids[i]] for i in again)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ranges, pa.int32()), pa.array([0] * len(ids) + [1] * len(again), pa.int32())], names=["doc_id", "text", "__range", "__copy"])

    dealt = map_arrow(d, deal, "doc_id long, text string, __range int, __copy int").repartitionById(max(filled, default=0) + 1, F.col("__range"))
    dealt = dealt.sortWithinPartitions("__range", "__copy", F.col("doc_id").asc_nulls_first(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in names[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document before, without its next one
        out: list[dict] = []
        for batch in batches:
            for doc_id, raw, where, copy in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("__range").to_pylist(), batch.column("__copy").to_pylist(), strict=True):
                if copy and not (held and held[3] == where):
                    continue  # another row of the id, whose first one did
                doc = Text(raw)
                bits = chain(features(raw, doc.entropy))
                if held and held[3] == where:
                    out.append({"doc_id": held[0]} | compare(held[1], held[2], doc, bits))
                held = None if copy else (doc_id, doc, bits, where)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_arrow(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
