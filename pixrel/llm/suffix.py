"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, found by interval expansion on a BWT.

Equal strings of LENGTH bytes hold the same least-hashed k-gram at the same offset, their anchor. So windows meet in
groups by anchor, and each group is a small generalised text, whose Burrows-Wheeler transform tells which windows
are repeated: breadth-first backward extension derives common prefixes by increasing value and stops at LENGTH.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixrel.llm.common import HASH, map_arrow, mix, n_parts, saved, texts

LENGTH, GRAM = 200, 32
#: Bytes of group texts that one transform takes. A larger group is halved by window starts and split by the bytes that
#: all windows of a half have in common, until the transform takes the rest.
CHUNK = 400_000
#: Occurrences beyond which an anchor's windows are grouped by what SPLIT neighbours (and at last each alone) have in common:
#: the same windows meet, in groups that no common passage makes large. Groups below HOT fit one transform.
HOT, HOTTEST, SPLIT = CHUNK // (2 * LENGTH), 200_000, 42
#: Documents whose anchors tell beforehand which anchors are hot. Occurrences of these never meet; the list only moves
#: work, as windows meet by what they have in common in any case.
SAMPLE_DOCS = 20_000
#: Windows of a text whose anchors are found at once; bytes of segments or texts that a task gathers before it hands them on.
SLICE, HELD = 8_000_000, 64_000_000
#: Prefix lengths that are compared word by word before the expansion starts.
DIRECT = 32


def anchors(buf: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Runs of windows with one anchor: hash and position of the anchor, first and last window start; and repeated spans.

    Where a gram comes back within a window and the windows before it are those a period earlier, byte by byte, they
    are repeated in the text itself. Such spans are told at once, and only their first windows need to meet others.
    """
    n = len(buf)
    if n < length:
        z = np.empty(0, np.int64)
        return z.astype(np.uint64), z, z, z, []
    at = np.arange(n - gram + 1)
    h = HASH.ranges(HASH.prefix(buf), at, at + gram)
    w = length - gram + 1  # grams of a window
    pad = -(-len(h) // w) * w
    full = np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(h)] = h
    blocks = full.reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(down[: n - length + 1], up[w - 1 : w - 1 + n - length + 1])
    # an anchor is the leftmost gram with the least hash of its window
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    ends = np.concatenate([change[1:], [len(low)]])
    found: list[tuple[int, int, int]] = []
    local: list[tuple[int, int]] = []
    raw = buf.tobytes()
    for value, a, b in zip(low[change], change.tolist(), ends.tolist(), strict=True):
        # windows a..b-1 share the least hash; equal grams within them split the run
        hits = (np.flatnonzero(h[a : b - 1 + w] == value) + a).tolist()
        start, before = a, None
        for hit in hits:
            stop = min(hit, b - 1)
            if start > stop:
                break
            period = hit - before if before is not None else 0
            if period and start >= period and raw[start - period : stop + length - period] == raw[start : stop + length]:
                if local and local[-1][1] >= start - period:
                    local[-1] = (local[-1][0], stop + length)
                else:
                    local.append((start - period, stop + length))
            else:
                found.append((hit, start, stop))
            start, before = stop + 1, hit
    p, a, b = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    return mix(h[p]), p, a, b, local  # least hashes crowd near 0: mixed, so that parts are even


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the starts of its windows of length bytes that start at another place of the segments as well."""
    sizes = np.array([len(s) for s in segments], np.int64)
    joined = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no byte of UTF-8
    term = np.cumsum(sizes + 1) - 1
    n = len(joined)
    b = joined.astype(np.uint64) + np.uint64(1)
    b[term] = 0
    rem = np.repeat(term, sizes + 1) - np.arange(n)

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[k:], np.zeros(k, x.dtype)])

    # eight letters in a word, nothing beyond the end of a segment
    word = b
    for k in (1, 2, 4):
        word = (word << np.uint64(8 * k)) | np.where((word & np.uint64(0xFF)) != 0, ahead(word, k), np.uint64(0))
    key, h = word, 8
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        if h >= length or int(rank.max()) == n - 1:
            break
        r = rank.astype(np.uint64)
        second = np.where(rem >= h, ahead(r, h) + np.uint64(1), np.uint64(0))
        if n < 1 << 21:
            third = np.where(rem >= 2 * h, ahead(r, 2 * h) + np.uint64(1), np.uint64(0))
            key, h = (r << np.uint64(42)) | (second << np.uint64(21)) | third, 3 * h
        else:
            key, h = (r << np.uint64(32)) | second, 2 * h
    sa = np.argsort((rank.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))  # equals by position
    bwt = np.where(sa > 0, b[np.maximum(sa - 1, 0)], 0).astype(np.uint8)
    by_letter = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_letter] = np.arange(n)
    after = np.full(n, n, np.int64)  # the next row with the same letter
    same = bwt[by_letter][1:] == bwt[by_letter][:-1]
    after[by_letter[:-1][same]] = by_letter[1:][same]
    # common prefixes below DIRECT, word by word; known[k] is of rows k - 1 and k
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    live, done = np.arange(1, n), 0
    while len(live) and done < min(DIRECT, length):
        x, y = word[np.minimum(sa[live - 1] + done, n - 1)], word[np.minimum(sa[live] + done, n - 1)]
        diff = x ^ y
        equal = np.zeros(len(live), np.int16)
        for k in range(7, -1, -1):
            equal += diff < (np.uint64(1) << np.uint64(8 * k)) if k else diff == 0
        ended = np.minimum(rem[sa[live - 1]], rem[sa[live]]) - done  # letters left before an end
        over = (equal < 8) | (ended < 8)
        lcp[live[over]] = done + np.minimum(equal[over], ended[over])
        live, done = live[~over], done + 8
    # expansion: boundaries of one value give those of the next by stepping backward with each letter of the interval before them
    front, value, unset = np.flatnonzero(lcp == done - 1), done, np.flatnonzero(lcp < 0)
    while len(live) and value < length:
        if len(front):
            unset = unset[lcp[unset] < 0]
            if not len(unset):
                break
            # the first row of the interval that ends at each boundary of the front: before the run of unset ones that ends there
            breaks = np.flatnonzero(np.diff(unset) != 1) + 1
            at = np.searchsorted(unset, front) - 1
            inside = (at >= 0) & (unset[np.maximum(at, 0)] == front - 1)
            first = unset[np.concatenate([[0], breaks])[np.searchsorted(breaks, at, "right")]]
            low = np.where(inside, first - 1, front - 1)
            size = front - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            last = (after[rows] >= np.repeat(front, size)) & (bwt[rows] != 0)
            found = lf[rows[last]] + 1
            found = found[lcp[found] < 0]
            lcp[found] = value
            front = found
        value += 1
    left = (lcp < 0) | (lcp >= length)
    again = left[:-1] | left[1:]
    hit = np.zeros(n, bool)
    hit[sa[again]] = True
    begin = term - sizes
    every = np.flatnonzero(hit)
    return [every[a:b] - s for a, b, s in zip(np.searchsorted(every, begin).tolist(), np.searchsorted(every, term).tolist(), begin.tolist(), strict=True)]


Item = tuple[int, int, bytes]


def split_repeats(items: list[tuple[int, bytes]], length: int = LENGTH, chunk: int = CHUNK) -> list[np.ndarray]:
    """As repeated_windows, for a group of any size: items are (lead, segment), the windows' places in a common cell and their bytes.

    Equal windows have one place in the cell, as they hold one anchor. So places are halved, and the segments of a
    half are grouped by the bytes that all its windows share, which are more at each turn; a group that fits goes to
    the transform, and a single place is left with equal windows alone.
    """
    found = [np.zeros(max(0, len(s) - length + 1), bool) for _, s in items]
    todo: list[tuple[list[Item], int, int]] = [([(i, lead, s) for i, (lead, s) in enumerate(items)], 0, max((lead + len(s) - length + 1 for lead, s in items), default=0))]
    while todo:
        group, lo, hi = todo.pop()
        if len(group) < 2 or hi <= lo:
            continue
        if hi - lo == 1:  # grouped by all their bytes
            for i, lead, _ in group:
                found[i][lo - items[i][0]] = True
            continue
        if sum(len(s) for _, _, s in group) <= chunk:
            for (i, lead, _), starts in zip(group, repeated_windows([s for _, _, s in group], length), strict=True):
                found[i][starts + lead - items[i][0]] = True
            continue
        mid = (lo + hi) // 2
        for a, b in ((lo, mid), (mid, hi)):
            halves: dict[bytes, list[Item]] = {}
            for i, lead, s in group:
                first, last = max(a, lead), min(b, lead + len(s) - length + 1)
                if first < last:
                    halves.setdefault(s[b - 1 - lead : a + length - lead], []).append((i, first, s[first - lead : last - 1 - lead + length]))
            todo += [(x, a, b) for x in halves.values()]
    return [np.flatnonzero(x) for x in found]


ANCHOR = np.dtype([("tail", "<u4"), ("pos", "<u4"), ("before", "u1"), ("after", "u1"), ("owner", "<u2")])
PLACE = np.dtype([("key", "V16"), ("name", "<u8"), ("pos", "<u4"), ("before", "u1"), ("after", "u1"), ("heat", "u1")])
#: Heat of a place that is a repeated span inside its text: from pos to name.
LOCAL = 255
SPOT = np.dtype([("key", "V16"), ("start", "<u4")])
SPAN = np.dtype([("key", "V16"), ("start", "<u4"), ("end", "<u4")])


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def name_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Name of an anchor: its part, and 32 bits of its hash that the part leaves open."""
    low = np.uint64(max(0, 32 - max(0, parts.bit_length() - 1)))
    return (part_of(h, parts).astype(np.uint64) << np.uint64(32)) | ((h >> low) & np.uint64(0xFFFFFFFF))


def home(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of a text by its key."""
    return part_of(np.frombuffer(keys.tobytes(), "<u8")[::2], parts)


def dealt(part: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    names, first = np.unique(part[order], return_index=True)
    for name, own in zip(names, np.split(order, first[1:]), strict=True):
        yield int(name), rows[own]


def arrow(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def sliced_anchors(t: bytes, length: int, gram: int, windows: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """anchors() of a text, so many windows at a time: an anchor follows from its window's bytes alone."""
    buf = np.frombuffer(t, np.uint8)
    got = []
    for at in range(0, max(1, len(t) - length + 1), windows):
        h, p, a, b, local = anchors(buf[at : at + windows + length - 1], length, gram)
        got.append((h, p + at, a + at, b + at, [(x + at, y + at) for x, y in local]))
    if len(got) == 1:
        return got[0]
    h, p, a, b, local = zip(*got, strict=True)
    return np.concatenate(h), np.concatenate(p), np.concatenate(a), np.concatenate(b), [x for y in local for x in y]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that spans cover; spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.append(new[1:], len(reach)) - 1]


def hot_anchors(only_text: DataFrame, n_docs: int, length: int, gram: int, parts: int) -> dict[int, int]:
    """Heat of the anchors with over a quarter of a part's share, as a sample of about SAMPLE_DOCS documents tells: 4 a part at most."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [name_of(sliced_anchors(t, length, gram)[0], parts) for t in texts(batch) if len(t) >= length]
            names, count = np.unique(np.concatenate(h), return_counts=True) if h else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(count.astype(np.int64))], names=["name", "n"])

    counts = saved(map_arrow(only_text.sample(share, seed=1) if share < 1 else only_text, run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1"), "hot")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") > max(HOT * share, 15, total / (4 * parts))).collect()
    return {r["name"] % (1 << 64): 2 if r["n"] / share > HOTTEST else 1 for r in found}


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the kept bytes.

    Texts are UTF-8 bytes, null is empty; those below length bytes keep all. Repeated rows and equal texts of any
    ids are copies: all their bytes go where they reach length. Rows without an id are treated alike; an empty table
    gives no row; other columns are not read. Equal texts pass the join once; distinct texts cross the network twice,
    and of repeated passages the bytes around each anchor. A text is held in one task, and some 60 bytes of memory for
    each of SLICE bytes of it.
    """
    spark = docs.sparkSession
    parts = n_parts(spark, docs.select(text))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    members = saved(d.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")), "members")
    only_text = d.select("text")
    hot = hot_anchors(only_text, members.count(), length, gram, parts)
    hot_names = np.array(sorted(hot), np.uint64)
    hot_heat = np.array([hot[k] for k in sorted(hot)], np.uint8)

    def routed(rows: np.ndarray) -> list[tuple[int, bytes]]:
        """Rows with a text's key, by the text's part."""
        return [(part, own.tobytes()) for part, own in dealt(home(rows["key"], parts), rows)]

    def to_texts(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(blobs)
        return arrow({"part": ([p for p, _ in blobs], pa.int32()), "kind": ([0] * n, pa.int32()), "rows": ([x for _, x in blobs], pa.binary()), "key": ([None] * n, pa.binary()), "text": ([None] * n, pa.string())})

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x[1] for x in held])
            spans = [(x[0], a, b) for x in held for a, b in x[5]]
            keys = np.frombuffer(b"".join(x[0] for x in held), "V16")
            owner = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
            pos = np.concatenate([x[2] for x in held])
            before, after = pos - np.concatenate([x[3] for x in held]), pos - np.concatenate([x[4] for x in held])
            name = name_of(h, parts)
            known = np.isin(name, hot_names)
            rows = np.zeros(int((~known).sum()), ANCHOR)
            for c, v in (("owner", owner), ("pos", pos), ("before", before), ("after", after), ("tail", name & np.uint64(0xFFFFFFFF))):
                rows[c] = v[~known]
            out = []
            for part, own in dealt((name[~known] >> np.uint64(32)).astype(np.int64), rows):
                used, local = np.unique(own["owner"], return_inverse=True)
                own = own.copy()
                own["owner"] = local
                out.append((part, own.tobytes(), keys[used].tobytes()))
            # places of hot anchors, and spans repeated in their text, go to their texts: told apart by their keys
            if known.any():
                own = np.zeros(int(known.sum()), PLACE)
                for c, v in (("key", keys[owner]), ("name", name), ("pos", pos), ("before", before), ("after", after)):
                    own[c] = v[known]
                own["heat"] = hot_heat[np.searchsorted(hot_names, name[known])]
                out += [(part, raw, b"") for part, raw in routed(own)]
            if spans:
                own = np.zeros(len(spans), PLACE)
                own["key"] = np.frombuffer(b"".join(x[0] for x in spans), "V16")
                own["pos"], own["name"], own["heat"] = [x[1] for x in spans], [x[2] for x in spans], LOCAL
                out += [(part, raw, b"") for part, raw in routed(own)]
            if out:
                cols = list(zip(*out, strict=True))
                yield arrow({"part": (cols[0], pa.int32()), "rows": (cols[1], pa.binary()), "keys": (cols[2], pa.binary())})

        total = 0
        for batch in batches:
            for t in texts(batch):
                key = hashlib.md5(t).digest()
                if key in seen or len(t) < length:
                    continue
                seen.add(key)
                held.append((key, *sliced_anchors(t, length, gram, SLICE)))
                total += len(held[-1][1])
                if total >= 2_000_000 or len(held) >= 60_000:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    def find_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, r, k in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "keys")), strict=True):
                if not k:
                    yield to_texts(routed(np.frombuffer(r, PLACE)))
                    continue
                rows = np.frombuffer(r, ANCHOR)
                keep = np.zeros(len(rows), PLACE)
                for c in ("pos", "before", "after"):
                    keep[c] = rows[c]
                keep["key"] = np.frombuffer(k, "V16")[rows["owner"]]
                keep["name"] = (np.uint64(p) << np.uint64(32)) | rows["tail"].astype(np.uint64)
                got.setdefault(p, []).append(keep)
        for p in sorted(got):
            rows = np.concatenate(got.pop(p))
            pair = np.frombuffer(rows["key"].tobytes(), "<u8").reshape(-1, 2)
            order = np.lexsort((rows["before"], rows["pos"], pair[:, 1], pair[:, 0], rows["name"]))
            rows, pair = rows[order], pair[order]
            new_name = np.concatenate([[True], rows["name"][1:] != rows["name"][:-1]])
            fresh = new_name.copy()  # a text may come from several tasks
            fresh[1:] |= (pair[1:] != pair[:-1]).any(axis=1) | (rows["pos"][1:] != rows["pos"][:-1]) | (rows["before"][1:] != rows["before"][:-1])
            rows, new_name = rows[fresh], new_name[fresh]
            group = np.cumsum(new_name) - 1
            count = np.bincount(group)[group]
            rows["heat"] = np.where(count > HOTTEST, 2, np.where(count > HOT, 1, 0))
            rows = rows[count > 1]
            if len(rows):
                yield to_texts(routed(rows))

    def deal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new, keys = [], []
            for i, t in enumerate(texts(batch)):
                key = hashlib.md5(t).digest()
                if key not in seen:
                    seen.add(key)
                    new.append(i)
                    keys.append(key)
            if new:
                n = len(new)
                part = home(np.frombuffer(b"".join(keys), "V16"), parts)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(keys, pa.binary()), batch.column(0).take(pa.array(new))], names=["part", "kind", "rows", "key", "text"])

    def by_key(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[bytes, bytes, np.ndarray]]:
        """Each distinct text of a part once, with its rows, which come first."""
        blobs: list[bytes] = []
        table: dict[bytes, np.ndarray] | None = None
        seen: set[bytes] = set()
        for batch in batches:
            for kind, rows, key, t in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), batch.column("key").to_pylist(), texts(batch), strict=True):
                if not kind:
                    blobs.append(rows)
                    continue
                if table is None:
                    every = np.frombuffer(b"".join(blobs), dtype)
                    blobs = []
                    pair = np.frombuffer(every["key"].tobytes(), "<u8").reshape(-1, 2)
                    every = every[np.lexsort((pair[:, 1], pair[:, 0]))]
                    cut = np.flatnonzero(np.concatenate([[True], every["key"][1:] != every["key"][:-1]])) if len(every) else np.empty(0, np.int64)
                    table = {every["key"][a].tobytes(): every[a:b] for a, b in zip(cut, [*cut[1:], len(every)], strict=False)}  # none without rows
                if key not in seen:
                    seen.add(key)
                    yield key, t, table.get(key, every[:0])

    def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments with one spot each: of a segment that a task has at several, all windows are repeated, and its spots are settled here."""
        segments: dict[tuple[int, int, int, bytes], list[bytes]] = {}
        spans: list[np.ndarray] = []
        size = 0

        def add(part: int, name: int, lead: int, seg: bytes, spot: bytes) -> None:
            nonlocal size
            segments.setdefault((part, name, lead, seg), []).append(spot)
            size += len(seg) + 200

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for (part, name, lead, seg), spots in segments.items():
                if len(spots) > 1:
                    at = np.frombuffer(b"".join(spots), SPOT)
                    own = np.zeros(len(at), SPAN)
                    own["key"], own["start"], own["end"] = at["key"], at["start"], at["start"] + len(seg)
                    spans.append(own)
                rows.append((part, name - (name >> 63 << 64), lead, seg, spots[0] if len(spots) == 1 else b""))
            segments.clear()
            if spans:
                rows += [(part, 0, 0, b"", raw) for part, raw in routed(np.concatenate(spans))]
                spans.clear()
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i : i + 20_000], strict=True))
                yield arrow({n: (c, t) for n, c, t in zip(("part", "name", "lead", "segment", "spots"), cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

        for key, t, places in by_key(batches, PLACE):
            local = places["heat"] == LOCAL
            if local.any():
                own = np.zeros(int(local.sum()), SPAN)
                own["key"], own["start"], own["end"] = places["key"][local], places["pos"][local], places["name"][local]
                spans.append(own)
                places = places[~local]
            lo, hi = places["pos"] - places["before"].astype(np.int64), places["pos"] - places["after"].astype(np.int64)
            for name, pos, a, b, heat in zip(places["name"].tolist(), places["pos"].tolist(), lo.tolist(), hi.tolist(), places["heat"].tolist(), strict=True):
                if not heat:
                    add(name >> 32, name, length - gram - (pos - a), t[a : b + length], key + a.to_bytes(4, "little"))
                    continue
                width = SPLIT if heat == 1 else 1
                for grid in range((pos - b) // width, (pos - a) // width + 1):  # starts by their distance before the anchor
                    begin, last = pos - grid * width - width + 1, pos - grid * width
                    # what all windows of the cell hold, here and in any text with the same anchor
                    core = hashlib.blake2b(t[last : begin + length], digest_size=8, salt=grid.to_bytes(2, "little")).digest()
                    h = int.from_bytes(core, "little")
                    first, last = max(begin, a), min(last, b)
                    add((h >> 32) * parts >> 32, h, first - begin, t[first : last + length], key + first.to_bytes(4, "little"))
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by name: a group is complete when the next begins."""
        out: list[np.ndarray] = []
        chunk: list[tuple[int, bytes, list[bytes], bool]] = []  # lead, segment, spots, whether it is known to come twice
        size = 0
        name: int | None = None
        group: dict[tuple[int, bytes], list] = {}

        def emit(seg: bytes, spots: list[bytes], starts: np.ndarray) -> None:
            if not len(starts) or not spots:
                return
            cut = np.flatnonzero(np.diff(starts) != 1)
            first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
            at = np.frombuffer(b"".join(spots), SPOT)
            spans = np.zeros((len(at), len(first)), SPAN)
            spans["key"] = at["key"][:, None]
            spans["start"] = at["start"][:, None] + first
            spans["end"] = at["start"][:, None] + last + length
            out.append(spans.ravel())

        def transform(rows: list[tuple[int, bytes, list[bytes], bool]], found: list[np.ndarray]) -> None:
            for (_, seg, spots, twice), starts in zip(rows, found, strict=True):
                emit(seg, spots, np.arange(len(seg) - length + 1) if twice else starts)

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield to_texts(routed(np.concatenate(out)))
                out.clear()

        def close() -> None:
            nonlocal chunk, size
            rows = [(lead, seg, spots, len(spots) > 1 or bool(more)) for (lead, seg), (spots, more) in group.items()]
            own = sum(len(r[1]) for r in rows)
            if len(rows) == 1 or all(r[3] for r in rows if r[2]):  # nothing to find out
                for _, seg, spots, twice in rows:
                    emit(seg, spots, np.arange(len(seg) - length + 1) if twice else np.empty(0, np.int64))
            elif own > CHUNK:
                transform(rows, split_repeats([(r[0], r[1]) for r in rows], length, CHUNK))
            else:
                chunk += rows
                size += own
                if size >= CHUNK:
                    transform(chunk, repeated_windows([r[1] for r in chunk], length))
                    chunk, size = [], 0

        for batch in batches:
            for n, lead, seg, spots in zip(*(batch.column(c).to_pylist() for c in ("name", "lead", "segment", "spots")), strict=True):
                if not seg:
                    out.append(np.frombuffer(spots, SPAN))
                    continue
                if n != name:
                    close()
                    name, group = n, {}
                held = group.setdefault((lead, seg), [[], 0])
                if spots:
                    held[0].append(spots)
                else:
                    held[1] += 1
            if sum(map(len, out)) > 200_000:
                yield from flush()
        close()
        if chunk:
            transform(chunk, repeated_windows([r[1] for r in chunk], length))
        yield from flush()

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return arrow({n: (c, k) for n, c, k in zip(["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], cols, [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=False)})

        for key, t, spans in by_key(batches, SPAN):
            kept, removed, runs = t, 0, 0
            if len(spans):
                start, end = merged(spans["start"], spans["end"])
                removed, runs = int((end - start).sum()), len(start)
                kept = b"".join([t[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(t)], strict=True)])
            rows.append((key, len(t), removed, runs, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            size += len(kept) * with_text
            if len(rows) >= 1000 or size > HELD:
                yield batch_of()
                rows, size = [], 0
        if rows:
            yield batch_of()

    mixed = "part int, kind int, rows binary, key binary, text string"

    def gather(rows: DataFrame) -> DataFrame:
        """Rows and texts of a part in one task, rows first."""
        return rows.unionByName(map_arrow(only_text, deal_texts, mixed)).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")

    found = map_arrow(map_arrow(only_text, find_anchors, "part int, rows binary, keys binary").repartitionById(parts, F.col("part")), find_repeats, mixed)
    segments = map_arrow(gather(found), cut_segments, "part int, name long, lead int, segment binary, spots binary")
    spans = map_arrow(segments.repartitionById(parts, F.col("part")).sortWithinPartitions("name"), judge, mixed)
    results = map_arrow(gather(spans), cut_texts, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    copies = members.groupBy("key").agg(F.count(F.lit(1)).alias("__copies"))
    twice = (F.col("__copies") > 1) & (F.col("n_bytes") >= length)
    r = results.join(copies, "key").select(
        "key", "n_bytes", F.when(twice, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(twice, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(twice, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"), *[F.when(twice, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] * with_text)
    # a table before the join, so that the rows of a text with very many copies can be split over tasks
    return members.join(saved(r, "results"), "key").drop("key")
