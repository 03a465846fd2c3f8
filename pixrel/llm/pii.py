"""PII: base patterns, then candidates of high recall scored by gradient boosted trees with calibrated thresholds."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixrel.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
# Base patterns of the contract, in forms that take linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the contract's matches, by start, then kind as listed."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at  # the local part is the run before the sign, back to the match before
        while start > done:
            lo = max(done, start - 256)
            run = len(_LOCAL.search(text, lo, start)[0])
            start -= run
            if start > lo:
                break
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _ANY_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_ANY_DIGIT = re.compile(r"[0-9]")
_AT = r"\s?(?:@|\[at\]|\(at\))\s?"
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\))\s?)"
#: High-recall generators: each proposes spans of its kind, whole runs of letters and digits without a bound on their
#: length; spans of one kind and of different kinds may overlap. The last two numbers bound the digits that a span of the
#: kind can have at all (none for emails).
CANDIDATES = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+"), 0, 1 << 30),
    ("ip", re.compile(r"(?<![0-9.])[0-9]++(?:(?:\.|\[\.\])[0-9]++){3}(?!\.?[0-9])"), 4, 12),
    ("card", re.compile(r"(?<![0-9])[0-9]++(?:[ ./_-]{1,2}[0-9]++)*+"), 12, 19),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ./_-]{1,2}[0-9]{2,6}){2,4}(?![0-9])"), 12, 19),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]++\)?(?:[ ./-]{1,2}\(?[0-9]++\)?)++"), 9, 15),
    ("phone", re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"), 9, 15),
)
#: Words in the 40 letters before or 20 after a span that speak for a kind, or against any.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "login", "addr"),
    "card": ("card", "visa", "credit", "payment", "paid", "carte", "tarjeta", "karte"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "cell", "sms", "anruf"),
}
AGAINST = ("version", " v", "release", "section", "isbn", "order", "invoice", "part no", "figure", "table", "page", "doi", "id ")


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    start, end, kind = span
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    groups = [len(x) for x in re.split(r"[^0-9]+", s) if x]
    parts = [min(int(x), 9999) for x in re.split(r"[^0-9]+", s) if x] or [0]
    near = before + " " + after
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), float(bool(digits) and luhn(digits)),
        s.count("."), s.count("-"), s.count(" "), float("(" in s), float("@" in s), float("at" in s.lower()), max(parts), float(len(set(digits)) <= 3),
        float(any(w in near for w in CONTEXT[kind])), float(any(w in before for w in AGAINST)), float(bool(before[-1:].isalnum())), float(bool(after[:1].isalnum())),
        float(digits[:1] in "3456"), float(before.rstrip()[-1:] == ":"), float(s[:2] == "00"), float("[" in s),
    ]


class Boosted:
    """Gradient boosted depth-limited regression trees for log loss, on quantile-binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> None:
        self.rounds, self.depth, self.rate, self.trees = rounds, depth, rate, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(len(y), self.bias)
        cuts = [np.unique(np.quantile(c, np.linspace(0.05, 0.95, 16))) for c in x.T]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            score += self.rate * self._apply(tree, x)
        return self

    def _grow(self, tree: list, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list, depth: int) -> int:
        at = len(tree)
        gs, hs = g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, 0, 0, gs / (hs + 1.0)))
        best = (1e-6, -1, 0.0)
        if depth:
            for f, c in enumerate(cuts):
                for t in c:
                    left = x[rows, f] <= t
                    a, b = g[rows][left].sum(), h[rows][left].sum()
                    gain = a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1)
                    if gain > best[0] and 5 <= left.sum() <= len(rows) - 5:
                        best = (gain, f, t)
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            one = self._grow(tree, x, g, h, rows[left], cuts, depth - 1)
            two = self._grow(tree, x, g, h, rows[~left], cuts, depth - 1)
            tree[at] = (best[1], best[2], one, two, 0.0)
        return at

    @staticmethod
    def _apply(tree: list, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        f, t, one, two, value = (np.array(c) for c in zip(*tree, strict=True))
        while (f[at] >= 0).any():
            go = f[at] >= 0
            left = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
            at = np.where(go, np.where(left, one[at], two[at]), at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum(self._apply(t, x) for t in self.trees)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    d = r.choice("3456") + _digits(r, r.choice([13, 14]))
    return d + next(c for c in "0123456789" if luhn(d + c))


def examples(seed: int, n: int) -> list[tuple[str, Span, bool]]:
    """Made-up sentences with a marked span: personal data in unusual forms, and look-alikes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(2, 8)))
    name = lambda: f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice(['', _digits(r, 2)])}"
    split = lambda d, sizes, sep: sep.join(d[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    out = []
    while len(out) < n:
        kind, good = r.choice(KINDS), r.random() < 0.5
        cue = r.choice(CONTEXT[kind]) + r.choice([" ", ": ", " me at ", " no "]) if good and r.random() < 0.9 else word() + " "
        if kind == "email":
            at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", ".")])
            s = f"{name()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}" if good else f"{word()}{r.choice([' @ ', '@ '])}{word()}.{_digits(r, 1)}.{_digits(r, 1)}"
        elif kind == "ip":
            s = r.choice([".", "[.]"]).join(str(r.randint(11, 255)) for _ in range(4)) if good else r.choice([".", "[.]"]).join(_digits(r, r.choice([1, 1, 2, 3, 4, 5])).lstrip("0") or "0" for _ in range(4))
            cue = cue if good else r.choice(["version ", "v", "release ", "section ", "figure ", word() + " "])
            if good and "[" not in s:
                s = s.replace(".", "[.]", 1)
        elif kind == "card":
            d = _card(r)
            s = split(d, [4, 4, 4, len(d) - 12], r.choice(["  ", ".", "_", " - "[:2]])) if good else r.choice([_digits(r, 16), split(_digits(r, 16), [4, 4, 4, 4], r.choice(["-", "/", "_"])), split(_digits(r, 13), [3, 1, 5, 4][:3] + [4], "-")])
            cue = cue if good else r.choice(["order ", "invoice ", "isbn ", word() + " ", "part no "])
        else:
            sep = r.choice(["-", " ", "."])
            s = r.choice([f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", split(_digits(r, 10), [3, 3, 4], sep), f"00{_digits(r, 2)} {_digits(r, 3)}{sep}{_digits(r, 3)}{sep}{_digits(r, 4)}"]) if good else split(_digits(r, 10), [r.choice([2, 3, 4]), 3, 4], r.choice([" ", "/", "-"]))
            cue = cue if good else r.choice(["order ", "table ", "page ", "id ", word() + " ", "figure "])
        head = " ".join(word() for _ in range(r.randint(0, 6)))
        text = f"{head} {cue}{s}{r.choice(['', '.', ',', ' ' + word()])} {word()}"
        start = len(head) + 1 + len(cue)
        out.append((text, (start, start + len(s), kind), good))
    return out


#: Names, hosts and sentences of the examples for calibration, which share nothing with those that the trees are fitted on.
_NAMES = ("Anna", "bjorn", "Chidi", "dolores", "Emeka", "fatima", "Goran", "hanako", "Ines", "jonas")
_HOSTS = ("acme-works", "uni-nord", "post", "kontor7", "library", "fjord", "shop24")
_SAYS = ("Please {} before Friday", "As agreed in the meeting, {} is what they gave us", "{}", "see also {} (internal)", "Das Team hat {} notiert", "on peut noter {} ici", "el valor era {} al final", "We found {} in the log")


def other_examples(seed: int, n: int) -> list[tuple[str, Span, bool]]:
    """Examples by another generator: fixed names and sentences, other spellings, and numbers of many everyday kinds."""
    r = random.Random(seed)
    group = lambda *sizes: [_digits(r, k) for k in sizes]
    out = []
    while len(out) < n:
        kind, good = r.choice(KINDS), r.random() < 0.5
        cue = f"{r.choice(CONTEXT[kind])}{r.choice([' ', ': ', ' is ', '-> '])}" if good and r.random() < 0.8 else r.choice(["", "the ", "about ", "und "])
        if kind == "email":
            at, dot = r.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", ".")])
            s = f"{r.choice(_NAMES)}{r.choice(['', '.', '_'])}{r.choice(_HOSTS)}{at}{r.choice(_HOSTS)}{dot}{r.choice(['org', 'de', 'io', 'co'])}" if good else f"{r.choice(['5', '12', 'met', 'price'])}{r.choice([' @ ', '@ ', ' @'])}{r.choice(['noon', '3', 'home', '20'])}.{r.choice(['5', '30', 'then', 'Next'])}"
        elif kind == "ip":
            s = "[.]".join(str(r.randint(1, 254)) for _ in range(4)) if good else r.choice(["[.]", "."]).join(str(r.choice([r.randint(256, 2030), r.randint(1000, 9000)])) for _ in range(4))
        elif kind == "card":
            d = _card(r)
            if good:
                s = r.choice([f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}", f"{d[:4]}_{d[4:8]}_{d[8:12]}_{d[12:]}", f"{d[:4]}  {d[4:8]}  {d[8:12]}  {d[12:]}", f"{d[:4]}/{d[4:8]}/{d[8:12]}/{d[12:]}"])
            else:
                s = r.choice([_digits(r, r.randint(12, 19)), ".".join(group(3, 3, 3, 3)), "-".join(group(4, 2, 2, 2, 2)), f"{_digits(r, 6)}.{_digits(r, 8)}", " ".join(group(3, 3, 3, 3)), "-".join(group(3, 1, 2, 6, 1)), "/".join(group(4, 4, 4, 4))])
                cue = r.choice(["order ", "ISBN ", "table ", "sum ", "serial ", "", "id "])
        else:
            sep = r.choice([" ", "-", "."])
            if good:
                s = r.choice([f"({_digits(r, 3)}) {_digits(r, 3)}{sep}{_digits(r, 4)}", sep.join(group(3, 3, 4)), f"0049 {_digits(r, 3)}{sep}{_digits(r, 3)}{sep}{_digits(r, 4)}"])
            else:
                s = r.choice([" ".join(group(3, 3, 3)), "-".join(group(4, 2, 2)) + " " + _digits(r, 2), f"{_digits(r, 4)}-{_digits(r, 4)} {_digits(r, 3)}", "/".join(group(2, 3, 4)), f"{_digits(r, 5)} {_digits(r, 5)}", ". ".join(group(2, 4, 4))])
                cue = r.choice(["order ", "table ", "pages ", "between ", "in ", "", "fig. "])
        head, _, rest = r.choice(_SAYS).partition("{}")
        text = f"{head}{cue}{s}{rest}"
        start = len(head) + len(cue)
        out.append((text, (start, start + len(s), kind), good))
    return out


def logistic(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that turns scores into probabilities, by Newton steps on the weighted log loss."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g, h = weight * (p - good), weight * p * (1 - p)
        grad = np.array([(g * score).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0] * min(1, 2 / np.abs(step).max()), b - step[1] * min(1, 2 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


#: Share of personal data among the candidates of ordinary text that calibration assumes, and the precision that a threshold
#: must reach at that share.
PREVALENCE, PRECISION = 0.1, 0.97


@cache
def model() -> tuple[Boosted, dict[str, tuple[float, float, float]]]:
    """The trees, and for each kind (slope, shift, threshold): the sigmoid that gives a candidate's probability, and the least
    probability at and above which PRECISION holds. Both come from examples of another generator than the trees'."""
    data = [(describe(t, s), good) for t, s, good in examples(11, 2000)]
    trees = Boosted().fit(np.array([x for x, _ in data]), np.array([y for _, y in data], float))
    held = other_examples(12, 4000)
    scores = trees.score(np.array([describe(t, s) for t, s, _ in held]))
    limits = {}
    for kind in KINDS:
        own = [i for i, (_, s, _) in enumerate(held) if s[2] == kind]
        score, good = scores[own], np.array([held[i][2] for i in own], float)
        weight = np.where(good == 1, PREVALENCE / good.mean(), (1 - PREVALENCE) / (1 - good.mean()))
        slope, shift = logistic(score, good, weight)
        p = 1 / (1 + np.exp(-(slope * score + shift)))
        order = np.lexsort((good, -p))  # of equal ones the false first
        right = np.cumsum((weight * good)[order]) / np.cumsum(weight[order])
        enough = np.flatnonzero(right >= PRECISION)
        limits[kind] = (slope, shift, float(p[order][enough[-1]]) if len(enough) else 2.0)
    return trees, limits


class Cover:
    """Intervals that do not overlap, in order: a sorted list with binary search, so that many spans take linearithmic time."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):  # base spans of different kinds may overlap
            if self.starts and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.ends, a + 1)  # the first that ends behind a
        return i == len(self.starts) or self.starts[i] >= b

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def candidates(text: str) -> list[Span]:
    """Spans that the generators propose, each once."""
    found: set[Span] = set()
    at = "@" in text or "at]" in text or "at)" in text
    if at or _ANY_DIGIT.search(text):
        for kind, pattern, least, most in CANDIDATES:
            if kind == "email" and not at:
                continue
            for m in pattern.finditer(text):
                if kind == "email" or m.end() - m.start() >= least and least <= len(_NOT_DIGIT.sub("", m[0])) <= most:
                    found.add((*m.span(), kind))
    return sorted(found)


def added_spans(text: str, base: list[Span], trees: Boosted, limits: dict[str, tuple[float, float, float]]) -> list[Span]:
    """Candidates whose probability reaches their kind's threshold, best first, none over a base span or another chosen one."""
    cover = Cover([(a, b) for a, b, _ in base])
    found = [s for s in candidates(text) if cover.free(s[0], s[1])]
    if not found:
        return []
    slope, shift, least = (np.array([limits[s[2]][i] for s in found]) for i in range(3))
    p = 1 / (1 + np.exp(-np.clip(slope * trees.score(np.array([describe(text, s) for s in found])) + shift, -40, 40)))
    out = []
    for q, s in sorted(zip(p[p >= least].tolist(), (found[i] for i in np.flatnonzero(p >= least)), strict=True), key=lambda x: (-x[0], x[1])):
        if cover.free(s[0], s[1]):
            out.append(s)
            cover.add(s[0], s[1])
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), redacted: str | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and added), and as redacted the text.

    Rows are independent: repeated ids and rows are searched each, an empty table gives none. A null text has no span
    and stays null; overlapping spans, and texts of any length, take time in proportion to their number times its
    logarithm. keep names further columns to hand through, whatever their names: of the results, those that bear the
    name of a kept column are left out, but redacted must not. The trees are trained once, on made-up examples, and
    sent to the tasks.
    """
    trees, limits = model()
    out = list(dict.fromkeys([id_col, *keep]))
    if redacted in out:
        raise ValueError(f"column {redacted} is kept: choose another name")
    made = [*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), (redacted, pa.string())]
    shown = [i for i, (n, _) in enumerate(made) if n and n not in out]
    names, types = [made[i][0] for i in shown], [made[i][1] for i in shown]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for t in batch.column(text).to_pylist():
                base = base_spans(t or "")
                spans = base + added_spans(t or "", base, trees, limits)
                got = [*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), redact(t, spans) if redacted and t is not None else None]
                for c, i in zip(rows, shown, strict=True):
                    c.append(got[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *(pa.array(c, k) for c, k in zip(rows, types, strict=True))], names=[*out, *names])

    schema = ", ".join([*fields, *(f"`{n}` {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True))])
    return map_arrow(docs.select(*dict.fromkeys([*out, text])), run, schema)
