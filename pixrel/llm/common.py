"""Shared pieces of the training-data operators: shared-folder tables, Arrow mapping, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixrel.plans.shared import drop_saved, remove, saved, scratch, shared_dir  # noqa: F401

#: Odd multiplier of the polynomial byte hash (golden-ratio constant) and its inverse modulo 2**64.
POLY = 0x9E3779B97F4A7C15
POLY_INV = pow(POLY, -1, 1 << 64)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def tidy() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with freed memory given back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


#: Bytes of input that one partition of an operator's own exchanges is meant for at most.
PART_BYTES, MOST_PARTS = 128 << 20, 1 << 17


def n_parts(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions of an exchange: the session's number, more where the files of df hold over PART_BYTES for each."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if df is not None else 0
    return max(n, min(MOST_PARTS, -(-size // PART_BYTES))) if size < 1 << 50 else n  # plans without files claim a share of 2**63


#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 20_000


def small_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with side, which has a row for each combination of keys and is a saved table, so that counting it is cheap.

    A side of BROADCAST_ROWS at most is broadcast, so that few keys do not gather rows in few tasks. Beyond that both
    are shuffled; nothing above the join asks for a key's rows together, so that Spark can split skewed partitions.
    """
    return rows.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, keys, how)


def powers(n: int, base: int = POLY) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class PolyHash:
    """Hashes modulo 2**64 of any byte ranges of a buffer, vectorised, from one prefix sum.

    hash(range) depends on the bytes of the range alone. Tables of powers grow to the longest buffer seen.
    """

    def __init__(self) -> None:
        self.up = self.down = powers(1)
        rng = np.random.RandomState(0x5EED)
        self.code = (rng.randint(1, 2**31 - 1, 256).astype(np.uint64) << np.uint64(32)) | rng.randint(1, 2**31 - 1, 256).astype(np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(n), powers(n, POLY_INV)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self.grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.code[buf] * self.up[: len(buf)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII white space as the contracts define it: space and 09-0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z for whole buffers.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of a buffer."""
    edge = np.empty(len(buf) + 2, np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~SPACE[buf]
    d = np.diff(edge)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


HASH = PolyHash()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    buf = np.frombuffer(text, np.uint8)
    s, e = word_bounds(buf)
    return HASH.ranges(HASH.prefix(buf), s, e) if len(s) else np.empty(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; of the whole sequence where there are fewer words."""
    k = min(k, len(words))
    if not k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out + words[i : i + n]) * np.uint64(POLY)
    return mix(out)
