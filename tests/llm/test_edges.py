"""Clashing columns, repeated ids, long texts, held-out quality: each operator's defined results, and measured ones."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixrel.llm import classifier, common, fingerprint, jaccard, licenses, mixing, pii, rules
from pixrel.plans import shared

WORD = r"[^\x20\x09-\x0D]+"


def test_stage_columns_of_any_name_are_the_users(spark, tmp_path):
    """Every result name of an operator is an extra column of the input: it goes through the stages unchanged."""
    names = ["redacted", "_redacted", "score", "predicted", "spans", "base_sha256", "n_email", "taken", "target", "license", "ids", "component_id", "n_shingles", "set_key", "fingerprint", "kept", "__near"]
    text = "mail jo.doe@mail.example.com now and then, said the man who walked along the river for many days"
    rows = [(i, f"{text} {'word ' * i}", "en", "a", 7, *[f"own {n}"[: 9 + i] for n in names]) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        mine = {r["doc_id"]: tuple(r[n] for n in names) for r in d.collect()}
        for r in out.collect():
            assert tuple(r[n] for n in names) == mine[r["doc_id"]]
            assert r["text"].startswith("mail ")
    hidden = {r["text"] for r in corpus_pipeline.private_data(spark, d, str(tmp_path)).collect()}
    assert all("<EMAIL>" in t and "jo.doe" not in t and "OTHER" not in t for t in hidden)


def test_stages_keep_an_empty_table_empty(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, str(tmp_path)).count() == 0


def test_pii_takes_whole_runs_and_linear_time():
    trees, limits = pii.model()
    local, host = "a" * 100 + ".b", "h" * 80
    text = f"mail me at {local} [at] {host} [dot] com please"
    assert pii.added_spans(text, [], trees, limits) == [(text.index(local), text.index(" please"), "email")]
    many = "call 555-123-4567 or jo [at] x [dot] org, " * 5_000
    base = pii.base_spans(many)
    assert len(pii.added_spans(many, base, trees, limits)) == 10_000
    for hard in ("a" * 200_000, "1 " * 100_000, "1." * 100_000, "a[at]" * 50_000, "(1)" * 70_000, "1_" * 100_000, "@" * 200_000):
        pii.added_spans(hard, pii.base_spans(hard), trees, limits)


def test_pii_thresholds_hold_on_new_examples_of_both_generators():
    trees, limits = pii.model()
    for make in (pii.examples, pii.other_examples):
        right, seen, wrong, false = Counter(), Counter(), Counter(), Counter()
        for text, span, good in make(99, 2000):
            base = pii.base_spans(text)
            if any(a < span[1] and span[0] < b for a, b, _ in base):
                continue  # the base patterns decide
            hit = any(a < span[1] and span[0] < b for a, b, _ in pii.added_spans(text, base, trees, limits))
            (seen if good else false)[span[2]] += 1
            (right if good else wrong)[span[2]] += hit
        assert all(right[k] >= 0.6 * seen[k] for k in ("email", "card", "phone"))
        assert sum(wrong.values()) <= 0.04 * sum(false.values())


def test_cover_equals_brute_force():
    r = random.Random(2)
    for _ in range(200):
        spans = [(a, a + r.randint(1, 9)) for a in (r.randrange(100) for _ in range(r.randint(0, 8)))]
        cover, taken = pii.Cover(spans), list(spans)
        for _ in range(20):
            a = r.randrange(100)
            b = a + r.randint(1, 9)
            free = all(b <= x or y <= a for x, y in taken)
            assert cover.free(a, b) == free
            if free:
                cover.add(a, b)
                taken.append((a, b))


def test_training_takes_one_text_of_an_id_whatever_the_order(spark):
    r = random.Random(1)
    rows = [(i % 40, f"{'good words here' if i % 2 else 'BAD!!! ###'} {r.random()} {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(1, None), (None, 1)], "doc_id long, quality int")
    models = [classifier.train(spark.createDataFrame(random.Random(s).sample(rows, len(rows)), "doc_id long, text string").repartition(1 + s), labels) for s in (0, 3)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias
    with pytest.raises(ValueError, match="score"):
        classifier.score(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, score int"), models[0], keep=("score",))


def test_margins_are_those_of_the_fitted_model():
    r = np.random.RandomState(0)
    rows = [np.unique(r.randint(0, 50, r.randint(1, 30))).astype(np.int32) for _ in range(200)]
    labels = np.array([int(np.isin(x, np.arange(25)).mean() > 0.5) for x in rows])
    m = classifier.fit(rows, labels)
    for x in rows[:20]:
        w, q = m.weights[x].astype(float), m.squares[x].astype(float)
        assert m.margin(x) == pytest.approx(m.bias + w.sum() / max(math.sqrt(q.sum()), 1e-9))
    margins = np.array([m.margin(x) for x in rows])
    assert margins[labels == 1].mean() > margins[labels == 0].mean()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy_of_the_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = classifier.train(docs, labels)
    rows = classifier.score(docs, m).join(labels, "doc_id").filter(classifier.held_out()).select("score", "predicted", "quality").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(rows) > 500 and auc >= 0.99 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.97


def brute_cosine(a, b, idf):
    dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a)
    return dot / math.sqrt(sum((n * idf(w)) ** 2 for w, n in a.items()) * sum((n * idf(w)) ** 2 for w, n in b.items()))


def test_licence_scores_equal_brute_force():
    r = random.Random(4)
    notes = [("A", "permission is granted to use this file"), ("B", "the license of the license version two applies")]
    words = "permission is granted to use this file the license of version two applies apple pear plum".split()
    corpus = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(50)]
    frequency = np.zeros(licenses.SLOTS, np.int64)
    for t in corpus:
        frequency[np.unique(licenses.slots(licenses.terms(t.encode())))] += 1
    m = licenses.Matcher(notes, frequency, len(corpus))
    idf = lambda w: math.log(51 / (1 + sum(w in t.encode().split() for t in corpus))) + 1
    assert all(m.table[licenses.slots([w])[0]] == pytest.approx(idf(w)) for w in {x.encode() for x in words})
    for _ in range(300):
        lines = [[r.choice(words).encode() for _ in range(r.randint(0, 9))] for _ in range(r.randint(1, 4))]
        flat, want = [w for x in lines for w in x], 0.0
        for _, t in notes:
            tw = licenses.terms(t.encode())
            n = min(len(tw), len(flat))
            for p in [x for x in lines if x] + [flat[i : i + n] for i in range(len(flat) - n + 1) if n]:
                want = max(want, brute_cosine(Counter(p), Counter(tw), idf))
        got = m.passages(lines)[0]
        assert got == pytest.approx(want if want >= licenses.COSINE else 0.0, abs=1e-9), (lines, want)


def test_quality_verdicts_equal_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(240):
        w = [f"w{r.randrange(400)}" for _ in range(r.randint(5, 60))]
        if i % 9 == 0:
            w = [x + "##" for x in w]
        if i % 7 == 0:
            w = w[:6] * 6
        rows.append((i, ("\n" if i % 5 else " ").join(w), r.choice(["en", "de", None]), r.choice(["a", "b", None])))
    measures = {i: rules.measure(t.encode()) for i, t, _, _ in rows}

    def metric(i):
        n, chars, symbols, dup, repeat, lines = measures[i]
        return {"symbol_rate": 1000 * symbols // chars if chars else None, "dup_line_rate": 1000 * dup // lines if lines else None, "repeat_rate": 1000 * repeat // n if n else None, "word_length": 100 * chars // n if n else None}

    failed = {i: measures[i][0] < 10 or 100 * measures[i][4] > 20 * measures[i][0] for i in measures}
    low = lambda v: v if v < 64 else v - v % (1 << (v.bit_length() - 6))

    def fence(ids, name):
        values = sorted(low(metric(i)[name]) for i in ids if not failed[i])
        if not values:
            return None
        at = lambda p: next(v for k, v in enumerate(values, 1) if 100 * k >= p * len(values))
        room = max(rules.SPREADS * (at(50) - at(10)), rules.METRICS[name])
        if name in rules.BOUNDS:
            room = min(room, (rules.BOUNDS[name] - at(50)) // 2)
        return at(50) + room, len(values)

    want = {}
    for i, _, lang, source in rows:
        own, wide = [k for k, _, g, s in rows if (g, s) == (lang, source)], [k for k, _, g, _ in rows if g == lang]
        over = []
        for name in rules.METRICS:
            f, g = fence(own, name), fence(wide, name)
            if f and metric(i)[name] > (f[1] * f[0] + rules.PRIOR_DOCS * g[0]) // (f[1] + rules.PRIOR_DOCS):
                over.append(name)
        want[i] = "base" if failed[i] else over[0] if over else None
    got = {x["doc_id"]: (x["reason"], x["kept"]) for x in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: (v, v is None) for i, v in want.items()} and len({v for v in want.values()}) >= 3


def test_fingerprints_equal_a_plain_form_and_tell_near_from_far():
    r = random.Random(6)
    text = lambda n: bytes(r.choice(b"abcdefgh ijklm nopq.") for _ in range(n))
    for n in (0, 10, 63, 64, 127, 128, 200, 900):
        raw = text(n)
        ent = fingerprint.Text(raw).entropy
        rank = [2000 if e < 100 or e > 990 else 1000 - abs(int(e) - 640) for e in ent]
        if n < 64:
            want = [raw] if raw else []
        elif len(rank) <= 64:
            k = min(range(len(rank)), key=lambda i: (rank[i], i))
            want = [raw[k : k + 64]]
        else:
            wins = Counter(min(range(s, s + 64), key=lambda i: (rank[i], i)) for s in range(len(rank) - 63))
            best = min(range(64), key=lambda i: (rank[i], i))
            chosen = sorted(k for k, v in wins.items() if v >= 16) or [best]
            want = list(dict.fromkeys(raw[k : k + 64] for k in chosen))
        hashes = [common.HASH.ranges(common.HASH.prefix(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0] for w in want]
        assert fingerprint.features(raw, ent).tolist() == [int(h) for h in hashes]
    bits = lambda t: fingerprint.chain(fingerprint.features(t, fingerprint.Text(t).entropy))
    near, far = [], []
    for _ in range(30):
        a, b = text(3000), text(3000)
        near.append(fingerprint.likeness(bits(a), bits(a[:1500] + b[:1500])))
        far.append(fingerprint.likeness(bits(a), bits(b)))
    assert min(near) > max(far) and np.mean(far) < 0.1


def test_a_long_text_among_short_ones(spark):
    r = random.Random(3)
    long = " ".join(f"word{r.randrange(10**6)}" for _ in range(400_000))
    d = spark.createDataFrame([(1, long, "en", "a"), (2, long + " tail", "en", "a"), (3, "a few short words and no more", "en", "b")], "doc_id long, text string, lang string, source string")
    assert {x["doc_id"]: x["component_id"] for x in jaccard.similar_classes(d).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x["doc_id"]: x["n_words"] for x in rules.judge(d).collect()} == {1: 400_000, 2: 400_001, 3: 7}
    assert {x["doc_id"]: x["n_chars"] for x in fingerprint.fingerprints(d).collect()}[1] == len(long)
    assert mixing.mix(d).agg(F.sum("size")).first()[0] == 800_008 and pii.find_pii(d).count() == 3


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """The near-duplicate, PII and mixing stages on plain input: who stays, what is hidden, how many words are taken."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [" ".join(word() for _ in range(80)) for _ in range(5)]
    rows = []
    for i in range(30):
        t = base[i % 5] + (f" {word()}" if i % 2 else "")
        rows.append((i, t if i < 20 else " ".join(word() for _ in range(60)) + " write to a.b@c.de", "en", "ab"[i % 2], len(t)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stays = sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, d, "").collect())
    assert stays == [*range(5), *range(20, 30)]
    hidden = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.private_data(spark, d, "").collect()}
    assert all(hidden[i] == ((t.replace("a.b@c.de", "<EMAIL>")), len(t.replace("a.b@c.de", "<EMAIL>"))) for i, t, *_ in rows)
    taken = corpus_pipeline.mixture(spark, d, "").collect()
    whole = {i: t for i, t, *_ in rows}
    assert all(whole[x["doc_id"]].startswith(x["text"].rstrip()) and x["n_chars"] == len(x["text"]) for x in taken)
    sizes = {s: sum(len(re.findall(WORD, t)) for _, t, _, q, _ in rows if q == s) for s in "ab"}
    got = {s: sum(len(re.findall(WORD, x["text"])) for x in taken if x["source"] == s) for s in "ab"}
    assert all(got[s] <= 3 * sizes[s] for s in "ab") and abs(sum(got.values()) - sum(sizes.values())) <= 2 * mixing.BLOCK_WORDS
    assert zlib.crc32(b"1") % 5 in range(5)
