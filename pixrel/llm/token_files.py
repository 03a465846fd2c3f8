"""Token files: canonical length-limited Huffman codes of ids from global counts, decoded by table in independent blocks."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tokenizers import Tokenizer

from pixrel.llm.bpe import WordSplitter
from pixrel.llm.common import map_arrow, n_parts, remove, scratch, texts

#: Tokens of a block (whole documents, so the last may pass it), tokens between checkpoints, longest code.
BLOCK_TOKENS, CHECKPOINT, MAX_BITS = 262_144, 64, 18
#: Bytes of text that are encoded at once, about; chunks that a generation remembers.
PIECE, CHUNKS = 1 << 20, 400_000
FILE_SCHEMA = "part int, first long, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for ids without a count."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.float64)
    package, levels = np.empty(0), []
    for _ in range(limit):
        both = np.concatenate([leaf, package])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaf))
        both = both[order]
        both = both[: len(both) // 2 * 2]
        package = both[::2] + both[1::2]
    need = 2 * len(leaf) - 2
    for is_leaf in levels[::-1]:
        leaves = int(is_leaf[:need].sum())
        lengths[used[:leaves]] += 1
        need = 2 * (need - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order of (length, id), and the ids in that order."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    top = int(lengths.max(initial=1))
    step = np.left_shift(1, top - lengths[ids])
    codes = np.zeros(len(lengths), np.uint64)
    codes[ids] = (np.cumsum(step) - step) >> (top - lengths[ids])
    return codes, ids


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Bits of the ids, most significant first, and the bits of each run of CHECKPOINT ids."""
    n = lengths[ids]
    off = np.cumsum(n) - n
    total = int(off[-1] + n[-1]) if len(ids) else 0
    word, shift = off >> 5, off & 31
    value = codes[ids] << (64 - shift - n).astype(np.uint64)
    out = np.zeros((total >> 5) + 2, np.uint64)
    at = np.flatnonzero(np.diff(word, prepend=-1))
    if len(at):
        out[word[at]] += np.add.reduceat(value >> np.uint64(32), at)
        out[word[at] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), at)
    starts = off[::CHECKPOINT]
    return out.astype(">u4").tobytes()[: (total + 7) // 8], np.diff(starts, append=total).astype("<u2").tobytes()


class Decoder:
    """Table of the codes, and lanes that each decode from a checkpoint."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.top = int(lengths.max(initial=1))
        _, ids = canonical(lengths)
        self.ids = np.zeros(1 << self.top, np.int32)
        self.bits = np.ones(1 << self.top, np.uint8)
        reach = np.left_shift(1, self.top - lengths[ids])
        filled = int(reach.sum())
        self.ids[:filled] = np.repeat(ids, reach)
        self.bits[:filled] = np.repeat(lengths[ids], reach)

    def unpack(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        words = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), ">u4").astype(np.uint64)
        spans = np.frombuffer(checkpoints, "<u2").astype(np.int64)
        at = np.cumsum(spans) - spans
        out = np.zeros((CHECKPOINT, len(at)), np.int32)
        last = n - (len(at) - 1) * CHECKPOINT
        for k in range(CHECKPOINT):
            if k == last:  # the last lane is over
                at = at[:-1]
            w = at >> 5
            two = (words[w] << np.uint64(32)) | words[w + 1]
            peek = ((two << (at & 31).astype(np.uint64)) >> np.uint64(64 - self.top)).astype(np.int64)
            out[k, : len(at)] = self.ids[peek]
            at = at + self.bits[peek]
        return out.T.ravel()[:n]


def range_buckets(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """At most n - 1 borders that deal the ids into even ranges; ids below the first border, and nulls, come first."""
    found = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    return sorted(set(found or []))


class ChunkEncoder(dict[bytes, bytes]):
    """Ids of chunks between white space. A new chunk is split into words as the library does, and its model encodes words that are new.

    No token holds white space and nothing before the tokens looks across it, so a text's ids are those of its chunks.
    Having the library encode whole texts takes more than twice the time that this operator may take, and new chunks
    whole half as much again. Chunks and words are remembered in two generations, the older of which goes when the
    newer is full.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # on the task's own thread
        self.splitter = WordSplitter(path)
        self.library = self.splitter.library
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("AZ") == "az"
        self.older: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.older_words: dict[bytes, bytes] = {}

    def word(self, w: bytes) -> bytes:
        ids = self.older_words.get(w)
        if ids is None:
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.library.model.tokenize("".join(map(self.splitter.letters.__getitem__, w)))])
        self.words[w] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            known = self.words.get
            ids = b"".join([p.to_bytes(4, "little") if type(p) is int else known(p) or self.word(p) for p in self.splitter.parts(chunk)])
        self[chunk] = ids
        return ids

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self) > CHUNKS:
            self.older = dict(self)
            self.clear()
        if len(self.words) > CHUNKS:
            self.older_words, self.words = self.words, {}
        get = self.__getitem__
        # letters that the library makes lower case anyway need not be told apart; special tokens are matched as they are
        return [b"".join(map(get, (t.lower() if self.lower and b"<" not in t else t).split())) for t in batch]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder of a file a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A text in pieces of about most bytes that begin at white space, so that a long text's chunks are not all in memory at once."""
    at = 0
    while len(text) - at > most and (cut := _BLANK.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def encoded(enc: ChunkEncoder, rows: list[bytes], end_id: int, piece: int) -> list[np.ndarray]:
    """Ids of each text, and end_id."""
    short = iter(enc.encode([x for x in rows if len(x) <= piece]))
    end = end_id.to_bytes(4, "little")
    return [np.frombuffer((next(short) if len(x) <= piece else b"".join(enc.encode([y])[0] for y in pieces(x, piece))) + end, "<u4") for x in rows]


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, text: str = "text", id_col: str = "doc_id", blocks: int = BLOCK_TOKENS) -> None:
    """Encode each text with the tokenizers library (chunk by chunk, see ChunkEncoder), append end_id, and write ids to path in ascending order of doc_id.

    path/blocks holds Parquet rows of FILE_SCHEMA, each a block that decodes on its own; path/codes holds the code
    lengths. Null texts are empty (the end id alone); null ids come first; rows of one id are ordered by a hash of
    their text, then by it, and deal out over ranges where they are many; repeated rows stay. An empty table gives no
    block. Other columns are not read. Texts cross the network once; ids are kept once, so that counting them does not
    encode twice.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = d.repartitionByRange(n_parts(spark, d), *order).sortWithinPartitions(*order, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        at = start = 0
        counts = np.zeros(size, np.int64)
        for batch in batches:
            doc_ids, rows = batch.column("doc_id"), texts(batch)
            for a, b in runs(rows):
                ids = encoded(enc, rows[a:b], end_id, PIECE)
                ends = np.cumsum([len(x) for x in ids])
                counts += np.bincount(np.concatenate(ids), minlength=size)
                yield pa.RecordBatch.from_arrays([pa.array([part] * (b - a), pa.int32()), pa.array(range(at, at + b - a), pa.int64()), doc_ids[a:b], pa.array(start + ends - [len(x) for x in ids]), pa.array([narrow(x) for x in ids], pa.binary()), pa.nulls(b - a, pa.binary())], names=names)
                at += b - a
                start += int(ends[-1])
        if at:  # how often the part has each id, in a row of its own
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=names)

    def runs(rows: list[bytes]) -> Iterator[tuple[int, int]]:
        """Slices of rows of about PIECE bytes, 256 rows at most."""
        first = size = 0
        for i, x in enumerate(rows):
            if i > first and (size + len(x) > PIECE or i - first == 256):
                yield first, i
                first = i
                size = 0
            size += len(x)
        if rows:
            yield first, len(rows)

    def narrow(ids: np.ndarray) -> bytes:
        return ids.astype("<u2" if small else "<u4").tobytes()

    def widen(ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, "<u2" if small else "<u4").astype(np.int64)

    names = ["part", "at", "doc_id", "start", "ids", "counts"]
    size = max(encoder(tokenizer_path).library.get_vocab_size(), end_id + 1)
    small = size <= 1 << 16
    kept = scratch(spark, "ids")
    map_arrow(ranged, encode, "part int, at long, doc_id long, start long, ids binary, counts binary").write.option("compression", "zstd").parquet(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(raw), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    # a row for each id of the vocabulary at most
    found = map_arrow(spark.read.parquet(kept).select("counts").filter("counts is not null"), count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()
    counts = np.zeros(size, np.int64)
    for i, c in found:
        counts[i] = c
    lengths = code_lengths(counts, MAX_BITS)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    codes, _ = canonical(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([widen(x[-1]) for x in held])
            payload, checkpoints = pack(ids, lengths, codes)
            part, first, _, start, _ = held[0]
            return pa.RecordBatch.from_pylist([{"part": part, "first": first, "start": start, "n_tokens": len(ids), "doc_ids": [x[2] for x in held], "doc_tokens": [len(x[-1]) // (2 if small else 4) for x in held], "checkpoints": checkpoints, "payload": payload}], schema=file_schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "start", "ids")), strict=True):
                if row[1] is None:
                    continue  # a row of counts
                if held and (row[0] != held[0][0] or row[1] != held[-1][1] + 1 or total >= blocks):
                    yield flush()
                    held, total = [], 0
                held.append(row)
                total += len(row[-1]) // (2 if small else 4)
        if held:
            yield flush()

    file_schema = to_arrow_schema(_parse_datatype_string(FILE_SCHEMA))
    # a split of the kept table is a run of a part's rows in order, so no shuffle
    map_arrow(spark.read.parquet(kept).drop("counts"), code, FILE_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, kept)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before), n_tokens, ids (little-endian 32-bit), ids_crc32."""
    lengths = np.zeros(1, np.int64)
    for i, bits in spark.read.parquet(f"{path}/codes").collect():  # at most a row for each id of the vocabulary
        if i >= len(lengths):
            lengths = np.concatenate([lengths, np.zeros(i + 1 - len(lengths), np.int64)])
        lengths[i] = bits
    found = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")
    # ids before each part: a row for each file; blocks know the ids before them in their part
    per_part = found.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    parts = {r["part"]: r["__n"] for r in per_part.collect()}
    before, total = {}, 0
    for p in sorted(parts):
        before[p], total = total, total + parts[p]
    tables: list[Decoder] = []

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(Decoder(lengths))
        for batch in batches:
            for row in batch.to_pylist():
                ids = tables[0].unpack(row["payload"], row["checkpoints"], row["n_tokens"]).astype("<u4")
                ends = np.cumsum(np.array(row["doc_tokens"], np.int64))
                starts = ends - np.array(row["doc_tokens"], np.int64)
                pieces = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + before[row["part"]] + row["start"]), pa.array(ends - starts), pa.array(pieces, pa.binary()), pa.array([zlib.crc32(x) for x in pieces], pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return map_arrow(found, decode, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
