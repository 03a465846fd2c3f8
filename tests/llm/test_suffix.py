"""Suffix-array dedup in all its paths, with small limits, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pixrel.llm import suffix


def brute(rows, length=200):
    count = Counter()
    for _, t in rows:
        t = (t or "").encode()
        count.update(t[k : k + length] for k in range(len(t) - length + 1))
    want = Counter()
    for x, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[x, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    return want


def got(spark, rows):
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out.collect())


def texts(seed, n):
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäé "
    passage = "".join(r.choice(letters) for _ in range(500))
    rows = []
    for i in range(n):
        p = list(passage)
        for _ in range(r.randint(0, 3)):
            p[r.randrange(len(p))] = "#"
        a, b = sorted((r.randint(0, 150), r.randint(300, 500)))
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 120))) + "".join(p[a:b])
        rows.append((i, t * r.choice([1, 1, 2])))
    return [*rows, (n, "ab" * 400), (n + 1, "x" * 1000), (n + 2, rows[0][1]), (None, passage), (n + 3, None), (n + 4, "")]


LIMITS = {"plain": {}, "hot": {"HOT": 3}, "hottest": {"HOT": 3, "HOTTEST": 6}, "halves": {"CHUNK": 1500}, "hot halves": {"HOT": 8, "CHUNK": 600}, "slices": {"SLICE": 130, "HELD": 4000}, "known": {"SAMPLE_DOCS": 0}}


@pytest.mark.parametrize("limits", LIMITS.values(), ids=LIMITS)
def test_every_path_equals_brute_force(spark, monkeypatch, limits):
    rows = texts(7, 40)
    for k, v in limits.items():
        monkeypatch.setattr(suffix, k, v)
    if "SAMPLE_DOCS" in limits:  # a list with hot, cold and absent anchors
        one = rows[0][1].encode()
        names = {int(x) for t in (one, rows[1][1].encode()) for x in suffix.name_of(suffix.sliced_anchors(t, 200, 32)[0], 4)}
        monkeypatch.setattr(suffix, "hot_anchors", lambda *a: {x: 1 + k % 2 for k, x in enumerate(sorted(names))} | {123: 1})
    elif limits:
        monkeypatch.setattr(suffix, "hot_anchors", lambda *a: {})
    assert got(spark, rows) == brute(rows)


def test_a_long_text_and_a_group_of_copies(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**5)}" for _ in range(120_000))
    rows = [(1, long), (2, long[:300_000] + "other " + long[400_000:])] + [(10 + i, long[1000:1400]) for i in range(60)]
    assert got(spark, rows) == brute(rows)
