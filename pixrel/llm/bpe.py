"""BPE encoding and decoding by speculation: longest matches propose, pair checks verify, only failing words merge exactly."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from pixrel.llm.common import map_arrow, texts

#: Distinct chunks and words kept per Python worker; beyond it a cache starts anew, results are the same.
CACHE_CHUNKS, CACHE_WORDS = 400_000, 400_000
#: Below this letter, classes of characters are the same in every version of Unicode that the libraries use.
STABLE = "\u0250"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordSplitter:
    """Normalised words of a text, for a tokenizers file of kind BPE with word ends (lower case, white space dropped)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.at_special = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None
        self.words = regex.compile(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.letters = byte_letters()
        self.back = {c: b for b, c in enumerate(self.letters)}
        self.cache: dict[bytes, bytes] = {}
        self.word_cache: dict[bytes, bytes] = {}

    def parts(self, chunk: bytes) -> list[bytes | int]:
        """Words (normalised, as bytes) and special ids of a chunk without ASCII white space."""
        if chunk.isalpha():  # ASCII letters alone
            return [chunk.lower()]
        text, out, at = chunk.decode(), [], 0
        for m in self.at_special.finditer(text) if self.at_special and "<" in text else ():
            out += [*self._split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, *self._split(text[at:])] if at < len(text) else out

    def _split(self, part: str) -> list[bytes]:
        if max(part, default="") < STABLE:
            part = self.space.sub(" ", unicodedata.normalize("NFC", part)).lower()
            return [w.encode() for w in self.words.findall(part)]
        with_library = self.library
        words = with_library.pre_tokenizer.pre_tokenize_str(with_library.normalizer.normalize_str(part))
        return [bytes(map(self.back.__getitem__, w)) for w, _ in words]


class SpeculativeBpe(WordSplitter):
    """Encoder by proposal and verification, and decoder."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        model = self.spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = t
        back = self.back
        self.base = [vocab[c] for c in self.letters]
        self.base_end = [vocab[c + self.end] for c in self.letters]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # rank of a merge by its pair; the formation time of a token is the rank of the merge that makes it
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        n = len(self.names)
        left, right, self.time = list(range(n)), list(range(n)), np.full(n, -1, np.int64)
        for r, (a, b) in enumerate(merges):
            t = self.made[r]
            if self.time[t] < 0:
                left[t], right[t], self.time[t] = vocab[a], vocab[b], r
        self.keys = np.array([a * n + b for a, b in self.rank], np.int64)
        order = np.argsort(self.keys)
        self.keys, self.key_rank = self.keys[order], np.arange(len(order), dtype=np.int64)[order]
        self.n = n
        self.left_spine, self.right_spine = self._spines(left), self._spines(right)
        # proposals: tokens that exact merging of their own bytes gives back
        self.mid: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for t, i in vocab.items():
            ends = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            raw = t[: -len(self.end)] if ends else t
            if all(c in back for c in raw):
                word = bytes(back[c] for c in raw)
                if self._merge(word, ends) == [i]:
                    (self.last if ends else self.mid)[word] = i
        self.longest = max(map(len, [*self.mid, *self.last]))
        self.checked = self.failed = 0

    def _spines(self, child: list[int]) -> np.ndarray:
        """For each token its chain of pieces at one edge, from the byte up to the token, padded with -1."""
        chains = []
        for t in range(self.n):
            chain = [t]
            while child[chain[-1]] != chain[-1]:
                chain.append(child[chain[-1]])
            chains.append(chain[::-1])
        out = np.full((self.n, max(map(len, chains)) + 1), -1, np.int32)
        for t, chain in enumerate(chains):
            out[t, : len(chain)] = chain
        return out

    def _merge(self, word: bytes, ends: bool = True) -> list[int]:
        """Exact BPE: the lowest rank first, of equal ranks the leftmost; a heap keeps it O(n log n) for long words."""
        ids = [self.base[b] for b in word]
        if ends:
            ids[-1] = self.base_end[word[-1]]
        n, rank = len(ids), self.rank
        if n <= 64:
            never = len(self.made)
            ranks = [rank.get(p, never) for p in zip(ids, ids[1:])]
            while ranks and (r := min(ranks)) < never:
                i = ranks.index(r)
                ids[i : i + 2] = [self.made[r]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((ids[i - 1], ids[i]), never)
                if i < len(ranks):
                    ranks[i] = rank.get((ids[i], ids[i + 1]), never)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in rank:
                heapq.heappush(heap, (rank[p], h, *p))
        return [x for x in ids if x >= 0]

    def _propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, i, n, mid = [], 0, len(word), self.mid
        while i < n:
            top = min(n, i + self.longest)
            if top == n and (t := self.last.get(word[i:])) is not None:
                out.append(t)
                break
            for j in range(top - (top == n), i, -1):
                if (t := mid.get(word[i:j])) is not None:
                    break
            else:  # one byte at the end, or a byte whose token exact merging changes
                j = i + 1
                t = (self.base_end if j == n else self.base)[word[i]]
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where merging the bytes of a and b together never joins across their border.

        The pieces at the border grow along a's right edge and b's left edge in order of merge ranks. A merge across
        happens if its rank comes before the next merge inside a, and not after the next one inside b (of equal
        ranks, the leftmost goes first).
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        sa, sb = self.right_spine[a], self.left_spine[b]
        i = np.zeros(len(a), np.int64)
        j = np.zeros(len(a), np.int64)
        never = np.int64(1 << 40)
        while len(live):
            rows = np.arange(len(live))
            x, y, up, uq = sa[rows, i], sb[rows, j], sa[rows, i + 1], sb[rows, j + 1]
            p = np.where(up >= 0, self.time[up], never)
            q = np.where(uq >= 0, self.time[uq], never)
            key = x.astype(np.int64) * self.n + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            m = np.where(self.keys[at] == key, self.key_rank[at], never)
            crossed = (m < p) & (m <= q) & (m < never)
            ok[live[crossed]] = False
            go = ~crossed & ((p < never) | (q < never))
            first = p <= q
            i, j = (i + first)[go], (j + ~first)[go]
            live, sa, sb = live[go], sa[go], sb[go]
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        got = [self._propose(w) for w in words]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((t for g in got for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(got)), sizes)
        inner = owner[1:] == owner[:-1]
        a, b, who = flat[:-1][inner], flat[1:][inner], owner[1:][inner]
        pairs, inverse = np.unique(a * self.n + b, return_inverse=True)
        bad = np.unique(who[~self.compatible(pairs // self.n, pairs % self.n)[inverse]]) if len(pairs) else []
        for k in bad:
            got[k] = self._merge(words[k])
        self.checked, self.failed = self.checked + len(words), self.failed + len(bad)
        return got

    def learn(self, chunks: list[bytes]) -> None:
        """Encode chunks (texts without ASCII white space) into the cache."""
        learn_chunks(chunks, self.cache, self.word_cache, self.parts, lambda words: [np.array(x, "<u4").tobytes() for x in self.encode_words(words)])

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. White space never lies inside a token, so chunks between it stand alone."""
        return encode_chunks(batch, self.cache, self.learn)

    def decode(self, ids: bytes) -> str:
        """As the library without a decoder: token names, joined by spaces."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_chunks(batch: list[bytes], cache: dict[bytes, bytes], learn: Callable[[list[bytes]], None]) -> list[bytes]:
    split = [t.split() for t in batch]
    if len(cache) > CACHE_CHUNKS:
        cache.clear()
    if new := [c for c in set(chain.from_iterable(split)) if c not in cache]:
        learn(new)
    return [b"".join(map(cache.__getitem__, s)) for s in split]


def learn_chunks(chunks: list[bytes], cache: dict[bytes, bytes], words: dict[bytes, bytes], parts: Callable[[bytes], list], encode_words: Callable[[list[bytes]], list[bytes]]) -> None:
    plan = [parts(c) for c in chunks]
    if len(words) > CACHE_WORDS:
        words.clear()
    new = list({p for x in plan for p in x if type(p) is bytes and p not in words})
    words.update(zip(new, encode_words(new), strict=True))
    for c, x in zip(chunks, plan, strict=True):
        cache[c] = b"".join([words[p] if type(p) is bytes else p.to_bytes(4, "little") for p in x])


_ENCODERS: dict[tuple[type, str], WordSplitter] = {}


def encoder(path: str, kind: type = SpeculativeBpe) -> WordSplitter:
    """One encoder of a kind a Python worker."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def slices(items: list, size: int = 256) -> Iterator[tuple[int, list]]:
    for i in range(0, len(items), size):
        yield i, items[i : i + size]


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """doc_id, ids (little-endian 32-bit), n_tokens, ids_sha256, decoded_sha256, and with keep_text the decoded text.

    Null and empty texts give no ids. Rows are independent, so repeated ids and rows stay; other columns are not read.
    tokenizer_path must exist on every executor, as the tokenizer package does.
    """
    more = ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for i, part in slices(texts(batch, text)):
                ids = enc.encode(part)
                decoded = [enc.decode(x).encode() for x in ids]
                cols = [batch.column(id_col)[i : i + len(part)], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                if keep_text:
                    cols.append(pa.array([x.decode() for x in decoded]))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"][: len(cols)])

    return map_arrow(docs.select(id_col, text), run, f"doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
