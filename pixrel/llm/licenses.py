"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixrel.llm.common import LOWER, map_arrow, saved, small_join, texts

#: Notices by SPDX identifier: fixed values, as the licences' own texts word them.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "LGPL-2.1": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",),
    "LGPL-3.0": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: Whole licences, for licence files and long headers.
FULL = {p.stem: (p.read_text(),) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: An identifier that a file states outright, without the suffixes that leave the licence the same.
SPDX = re.compile(rb"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)")
#: Least cosine of a passage to a template, and least share of a text's words in licence lines that makes it a licence file.
COSINE, FILE_PERCENT = 0.75, 25

#: Punctuation, and the marks that comments begin, continue and end with.
_TRIM = b".,;:()\"'#*/<>!-%`"
#: Windows of a long template are scored at so many places along its length.
STEPS = 16


def terms(line: bytes) -> list[bytes]:
    """Lower-case words without punctuation and comment marks around them."""
    return [w for x in line.translate(LOWER).split() if (w := x.strip(_TRIM))]


def spdx(text: bytes, names: set[str]) -> str:
    """The first known licence that the text's SPDX lines name; empty without one."""
    for found in SPDX.findall(text):
        name = re.sub(r"(-only|-or-later|\+)$", "", found.decode())
        if name in names:
            return name
    return ""


#: Slots of the table of document frequencies, a number each: 8 MB, whatever the input. Terms that share a slot count
#: together, so that a term never weighs more than its own frequency allows; CHUNKS is the pieces it is summed in.
SLOTS, CHUNKS = 1 << 20, 32


def slots(words: list[bytes]) -> np.ndarray:
    """Slot of each term."""
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (SLOTS - 1)


class Matcher:
    """Cosine of passages to templates. All terms weigh by the corpus: frequency holds the documents of each slot."""

    def __init__(self, templates: list[tuple[str, str]], frequency: np.ndarray, n_docs: int) -> None:
        self.table = np.log((1 + n_docs) / (1 + np.minimum(frequency, n_docs))) + 1
        counts = [Counter(terms(t.encode())) for _, t in templates]
        self.names = [name for name, _ in templates]
        self.known = set(self.names)
        self.length = [sum(c.values()) for c in counts]
        every = sorted({w for c in counts for w in c})
        self.idf = dict(zip(every, self.table[slots(every)].tolist(), strict=True))
        self.vocabulary = frozenset(self.idf)
        self.weights: list[dict[bytes, float]] = []
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            self.weights.append({w: n * self.idf[w] / norm for w, n in c.items()})
            for w, v in self.weights[i].items():
                self.postings.setdefault(w, []).append((i, v * v))

    def possible(self, words: list[bytes]) -> list[int]:
        """Templates that some passage of these words can reach: a cosine is at most the length of the template's part that they share."""
        share: dict[int, float] = {}
        for w in self.vocabulary.intersection(words):
            for i, v in self.postings[w]:
                share[i] = share.get(i, 0.0) + v
        return sorted(i for i, v in share.items() if v >= COSINE * COSINE - 1e-9)

    def passages(self, lines: list[list[bytes]]) -> tuple[float, str, int]:
        """Highest cosine of a passage, its licence (the first template of equals) and the words that passages at COSINE or more cover.

        Passages are the lines, and the windows of each template's length over all words, lines and comments aside; a
        text shorter than a template is one window.
        """
        words = [w for x in lines for w in x]
        open_ = self.possible(words)
        if not open_:
            return 0.0, "", 0
        ids: dict[bytes, int] = {}
        at = np.array([ids.setdefault(w, len(ids)) for w in words])
        idf = self.table[slots(list(ids))]
        ends = np.cumsum([len(x) for x in lines])
        spans = [(int(e) - len(x), int(e)) for e, x in zip(ends, lines, strict=True) if x]
        square = np.concatenate([[0.0], np.cumsum((idf * idf)[at])])
        covered = np.zeros(len(words) + 1, np.int64)
        best, name = 0.0, ""
        for i in open_:
            weight = np.array([self.weights[i].get(w, 0.0) for w in ids]) * idf
            dot = np.concatenate([[0.0], np.cumsum(weight[at])])
            n = min(self.length[i], len(words))
            step = max(1, n // (2 * STEPS)) if n > 4 * STEPS else 1
            starts = np.unique(np.append(np.arange(0, len(words) - n + 1, step), len(words) - n))
            first = np.concatenate([starts, [a for a, _ in spans]]).astype(np.int64)
            last = np.concatenate([starts + n, [b for _, b in spans]]).astype(np.int64)
            # repeated words only lengthen a passage, so this cosine is the highest that it may have
            may = (dot[last] - dot[first]) / np.sqrt(square[last] - square[first]) >= COSINE - 1e-9
            for a, b in zip(first[may].tolist(), last[may].tolist(), strict=True):
                held, times = np.unique(at[a:b], return_counts=True)
                score = min(1.0, float((times * weight[held]).sum() / math.sqrt(((times * idf[held]) ** 2).sum())))
                if score >= COSINE:
                    covered[a] += 1
                    covered[b] -= 1
                    if score > best + 1e-12:
                        best, name = score, self.names[i]
        return best, name, int((np.cumsum(covered) > 0).sum())


def scan(docs: DataFrame, path: Column, text: str = "text", id_col: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, path, license, score, how ('header', 'inherited' or 'none'), from_dir.

    An SPDX line that names a known licence decides, with score 1. Otherwise lines and windows of a text are held
    against the templates, notices as well as whole licences; the best at COSINE or more is the text's own licence.
    Texts that consist of licence passages by FILE_PERCENT of their words are licence files, and speak for their directory
    (the most frequent licence of its files, then the first by name). Texts without a licence of their own inherit
    that of the nearest ancestor directory that has one. Terms weigh by the documents that hold them, of all rows. Null
    and empty texts have no line; null paths lie in no directory. Repeated rows and ids are files of their own, each with
    a vote; an empty table gives no row; other columns are not read. A text is matched whole, in one task.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text).alias("text"))
    flat = [(name, t) for x in (templates, FULL) for name, y in sorted(x.items()) if name in templates for t in y]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n, known = np.zeros(SLOTS, np.int64), 0, {}
        for batch in batches:
            for t in texts(batch):
                n += 1
                found = [known[w] if w in known else known.setdefault(w, zlib.crc32(w) & (SLOTS - 1)) for w in set(terms(t))]
                count[found] += 1  # a slot once a document
                if len(known) > 500_000:
                    known.clear()
        size = SLOTS // CHUNKS
        blobs = [zlib.compress(count[i * size : (i + 1) * size].tobytes(), 1) for i in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n, *[0] * (CHUNKS - 1)], pa.int64())], names=["chunk", "counts", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: Counter[int] = Counter()
        for batch in batches:
            for chunk, raw, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.int64)
                total[chunk] = total[chunk] + part if chunk in total else part
                n[chunk] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary()), pa.array([n[c] for c in total], pa.int64())], names=["chunk", "counts", "n"])

    # SLOTS numbers, whatever the input
    pieces = map_arrow(map_arrow(d.select("text"), frequencies, "chunk int, counts binary, n long").repartitionById(CHUNKS, F.col("chunk")), summed, "chunk int, counts binary, n long").collect()
    frequency = np.zeros(SLOTS, np.int64)
    for r in pieces:
        frequency[r["chunk"] * (SLOTS // CHUNKS) : (r["chunk"] + 1) * (SLOTS // CHUNKS)] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    sent = d.sparkSession.sparkContext.broadcast(Matcher(flat, frequency, sum(r["n"] for r in pieces)))
    del frequency, pieces

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = sent.value
        for batch in batches:
            out = []
            for t in texts(batch):
                lines = [terms(x) for x in t.split(b"\n")]
                total = sum(map(len, lines))
                score, name, covered = matcher.passages(lines)
                if stated := spdx(t, matcher.known):
                    covered = max(covered, 2)  # the identifier's line
                    score, name = 1.0, stated
                out.append((name or None, score, bool(name) and covered * 100 >= FILE_PERCENT * total))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["doc_id", "path", "own", "score", "is_file"])

    types = {f.name: f.dataType.simpleString() for f in d.schema}
    m = saved(map_arrow(d, match, f"doc_id {types['doc_id']}, path string, own string, score double, is_file boolean"), "licenses")
    m = m.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    votes = m.filter("is_file and dir is not null").groupBy("dir", "own").agg(F.count(F.lit(1)).alias("n"))
    speaks = votes.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "own"))).filter("rank = 1").select(F.col("dir").alias("from_dir"), F.col("own").alias("inherited"))
    parts = F.split("dir", "/")
    above = m.select("dir").distinct().filter("dir is not null").withColumn("from_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).distinct()
    near = above.join(speaks, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "inherited"), F.length("from_dir")).alias("near")).select("dir", "near.*")
    j = small_join(m, saved(near, "near"), ["dir"], "left")
    how = F.when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return j.select("doc_id", "path", F.coalesce("own", "inherited").alias("license"), "score", how.alias("how"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))
