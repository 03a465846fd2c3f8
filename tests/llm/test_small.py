"""Pure-Python parts against brute force."""

import random
import re

import numpy as np
import pytest

from pixrel.llm import fingerprint, jaccard, pii, rules, suffix, token_files


def brute_classes(sets, percent=75):
    top = list(range(len(sets)))
    find = lambda i: i if top[i] == i else find(top[i])
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(6))
def test_region_join_is_exact(seed):
    r = random.Random(seed)
    sets = []
    for _ in range(8):
        base = r.sample(range(400), r.randint(5, 60))
        for _ in range(r.randint(1, 8)):
            s = set(base)
            for _ in range(r.randint(0, max(1, len(base) // 4))):
                s.discard(r.choice(base))
                s.add(r.randrange(400))
            sets.append(np.array(sorted(s), np.uint64))
    top, _ = jaccard.region_join(sets)
    assert top.tolist() == brute_classes(sets)


def test_region_join_tight_group_takes_few_pivots():
    base = set(range(1000))
    sets = [np.array(sorted(base - {i} | {10_000 + i}), np.uint64) for i in range(300)]
    top, pivots = jaccard.region_join(sets)
    assert not top.any() and pivots < 5


RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_the_plain_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "b.", "@", "x@y.zz", "1", "25", "255.", ".", "+", "+1 (", ")", " ", "-", "4111111111111111", "ü", "0", "192.168.0.1"]) for _ in range(r.randint(1, 14)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000):
        pii.base_spans(text)


def test_added_spans_leave_plain_numbers_alone():
    trees, limits = pii.model()
    for text in ("order 2123465659789240 is", "version 1.2.3.4.5", "in 1999 and 2004", "a total of 12 345 678 items", ""):
        base = pii.base_spans(text)
        assert pii.added_spans(text, base, trees, limits) == [], text
    text = "mail me at jo.doe [at] example [dot] com"
    assert pii.added_spans(text, [], trees, limits)


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def test_measures_match_brute_force():
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "ab ", "\x0b", "\x85", " ", "c d e f g "]) for _ in range(r.randint(0, 60)))
        assert rules.measure(text.encode())[:5] == brute_measure(text), text


def test_huffman_round_trip_and_length_limit():
    rng = np.random.RandomState(1)
    for n, size, limit in ((1, 3, 20), (63, 5, 4), (64, 300, 12), (65, 300, 9), (5000, 300, 10)):
        ids = np.minimum(rng.geometric(0.05, n), size - 1)
        counts = np.bincount(ids, minlength=size)
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        codes, _ = token_files.canonical(lengths)
        payload, checkpoints = token_files.pack(ids, lengths, codes)
        assert token_files.Decoder(lengths).unpack(payload, checkpoints, n).tolist() == ids.tolist()


def test_window_entropy_and_splicing():
    r = random.Random(2)
    for n in (64, 65, 100, 500):
        raw = bytes(r.choice(b"abc  deffgh") for _ in range(n))
        got = fingerprint.window_entropy(np.frombuffer(raw, np.uint8))
        for i in range(n - 63):
            c = np.bincount(np.frombuffer(raw[i : i + 64], np.uint8))
            c = c[c > 0] / 64
            want = -1000 * (c * np.log2(c)).sum() / 6
            assert abs(got[i] - want) <= 1.1
    for _ in range(200):
        a, b = (fingerprint.Text(bytes(r.choice(b"abcdefgh ij") for _ in range(r.randint(0, 300)))) for _ in range(2))
        cut, take = r.randint(0, len(a.raw)), r.randint(0, len(b.raw))
        raw = a.raw[:cut] + b.raw[:take]
        want = fingerprint.Text(raw).entropy
        assert np.array_equal(fingerprint.spliced_entropy(a, cut, b, take, raw), want)


def test_repeated_windows_match_brute_force():
    r = random.Random(1)
    for _ in range(150):
        length = r.choice([5, 40, 60])
        base = bytes(r.choice(b"abc ") for _ in range(200))
        segments = []
        for _ in range(r.randint(1, 12)):
            a = r.randint(0, 100)
            s = bytearray(base[a : a + length + r.randint(0, 60)])
            for _ in range(r.randint(0, 2)):
                s[r.randrange(len(s))] = r.choice(b"abcxyz")
            segments.append(bytes(s))
        count = {}
        for s in segments:
            for i in range(len(s) - length + 1):
                count[s[i : i + length]] = count.get(s[i : i + length], 0) + 1
        want = [[i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1] for s in segments]
        assert [x.tolist() for x in suffix.repeated_windows(segments, length)] == want


def test_anchors_cover_every_window_or_tell_it_repeated():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(200, 900)
        text = bytes(r.choice(b"ab") if r.random() < 0.5 else r.choice(b"abcdefgh") for _ in range(n))
        if r.random() < 0.4:
            text = text[:37] * (n // 37)
        _, _, first, last, local = suffix.anchors(np.frombuffer(text, np.uint8))
        met = {k for a, b in zip(first, last, strict=True) for k in range(a, b + 1)}
        windows = [text[k : k + 200] for k in range(len(text) - 199)]
        assert {windows[k] for k in met} == set(windows)  # each meets others once at least
        again = {k for k, x in enumerate(windows) if windows.count(x) > 1}
        covered = {i for k in again for i in range(k, k + 200)}
        assert {i for a, b in local for i in range(a, b)} <= covered
        assert set(range(len(windows))) - met <= {k for a, b in local for k in range(a, b - 199)}


def test_split_repeats_match_brute_force():
    """Segments of one cell: windows at the same place may be equal, and only there."""
    r = random.Random(4)
    for _ in range(200):
        length, width = r.choice([(40, 9), (60, 13)])
        core = bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(length - width + 1))
        items = []
        for _ in range(r.randint(2, 30)):
            sides = [bytes(r.choice(b"xy") for _ in range(width - 1)) for _ in range(2)]
            lead, last = sorted((r.randrange(width), r.randrange(width)))
            items.append((lead, (sides[0] + core + sides[1])[lead : last + length]))
        count: dict = {}
        for k, s in items:
            for i in range(len(s) - length + 1):
                count[k + i, s[i : i + length]] = count.get((k + i, s[i : i + length]), 0) + 1
        want = [[i for i in range(len(s) - length + 1) if count[k + i, s[i : i + length]] > 1] for k, s in items]
        assert [x.tolist() for x in suffix.split_repeats(items, length, chunk=r.choice([1, 300, 10_000]))] == want


def test_merged_runs():
    start, end = suffix.merged(np.array([50, 0, 5, 20, 60]), np.array([60, 5, 9, 30, 61]))
    assert start.tolist() == [0, 20, 50] and end.tolist() == [9, 30, 61]


def test_chunks_are_encoded_as_whole_texts_are(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    enc, r = token_files.ChunkEncoder(path), random.Random(1)
    monkeypatch.setattr(token_files, "CHUNKS", 300)  # generations change
    letters = ["a", "İ", "Σ", "ς", "e\u0301", "\u0308", "'s", "'S", "<|endoftext|>", "<|", "日本", "\xa0", "\u2009", "\x85", "\x1c", "1", "!", "..", "ß", "ﬁ", "K", "\u200b", "THE", "word"]
    for _ in range(400):
        rows = [r.choice([" ", "\n", " \t "]).join("".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 5))) for _ in range(5)]
        want = [[*enc.library.encode(x, add_special_tokens=False).ids, 1] for x in rows]
        assert [x.tolist() for x in token_files.encoded(enc, [x.encode() for x in rows], 1, r.choice([4, 30, 1000]))] == want
