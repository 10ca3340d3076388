"""Toxicity by held-out accuracy, counts and fits against plain versions."""

import math
import random
import zlib

import numpy as np

from loomsift.llm import toxicity as T
from loomsift.llm.suite import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
MILD = "river stone window garden letter morning paper yellow travel simple".split()
RUDE = "blockhead nitwit dunce".split()


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def written_docs(n=400):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(MILD) for _ in range(rng.randint(5, 60))]
        rude = i % 5 == 0
        if rude:
            words[rng.randrange(len(words))] = rng.choice(RUDE)
        docs.append((i, " ".join(words), "en", "a", 0))
        if i % 3:
            labels.append((i, 1, int(rude)))
    return docs, labels


def test_op12_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    df = queries()["op12_toxicity"](spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = df.collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    caught = sum(r.predicted for r in held if toxic[r.doc_id])
    assert caught >= 0.85 * sum(toxic[r.doc_id] for r in held)
    assert sum(r.predicted for r in held if not toxic[r.doc_id]) <= 0.02 * len(held)


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = written_docs()
    rows = {r.doc_id: r for r in T.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(rows[i].predicted == int(i % 5 == 0) for i in range(400))
    # Labels of held-out rows change nothing, nor do the other columns.
    turned = [(i, q, 1 - t if is_held_out(i) else t) for i, q, t in labels]
    moved = [(i, t, "xx", None, None) for i, t, *_ in docs]
    again = {r.doc_id: r for r in T.toxicity(spark.createDataFrame(moved, DOCS), spark.createDataFrame(turned, LABELS)).collect()}
    assert all(abs(again[i].score - rows[i].score) < 1e-9 for i in rows)


def test_odd_rows(spark, odd_docs, no_docs, wide):
    docs, labels = written_docs(200)
    rude = spark.createDataFrame([(900, "x " * 200_000 + "you nitwit", "en", "a", 0), (901, "y " * 200_000, "en", "a", 0)], DOCS)
    all_docs = wide(spark.createDataFrame(docs, DOCS).union(odd_docs).union(rude), ["toxic", "score", "hash", "held_out", "bucket", "n"])
    marks = spark.createDataFrame([*labels, *labels[:5], (None, 1, 1), (7, 1, None), (12345, 0, 1)], LABELS)
    got = T.toxicity(all_docs, marks).collect()
    assert len(got) == all_docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].predicted == 1 and by_id[901].predicted == 0 and by_id[None].held_out is False
    assert by_id[900].score > by_id[901].score
    empty = [r.score for r in got if r.doc_id in (2,)]
    assert all(0 < s < 0.3 for s in empty)
    assert T.toxicity(no_docs, marks).collect() == []
    none = T.toxicity(odd_docs, marks.limit(0)).collect()
    assert len(none) == odd_docs.count() and {r.score for r in none} == {0.0}
    ones = T.toxicity(odd_docs, spark.createDataFrame([(i, 0, 1) for i in range(9)], LABELS)).collect()
    assert {r.score for r in ones} == {1.0}


def test_copies_are_weights(spark):
    """A third of the labelled rows one text: the fit sees it once, with its count."""
    docs, labels = written_docs(400)
    docs += [(i, "stone window river", "en", "a", 0) for i in range(1000, 1300)]
    labels += [(i, 1, 0) for i in range(1000, 1300)]
    rows = {r.doc_id: r for r in T.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert len({rows[i].score for i in range(1000, 1300)}) == 1 and rows[1000].predicted == 0
    assert all(rows[i].predicted == int(i % 5 == 0) for i in range(400))


def plain_buckets(text):
    padded = [32 if ord(c) <= 32 else ord(c) for c in f" {text.lower()} "]
    out = set()
    for n in T.SIZES:
        for i in range(len(padded) - n + 1):
            h = padded[i] * 0x01000193 & 0xFFFFFFFF
            for c in padded[i + 1:i + n]:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
            out.add((h ^ h >> 15) * 0x9E3779B1 % 2**32 >> 32 - T.BUCKET_BITS)
    return out


def test_presence_is_each_bucket_once(monkeypatch):
    texts = ["", "a", "ab", "Hello  World\n", "naïve 日本 😀", "ab" * 300, "the cat sat on the mat " * 20]
    want = [plain_buckets(t) for t in texts]
    for size in (1 << 20, 7):
        monkeypatch.setattr(T, "CHUNK_CHARS", size)
        seen = T.Presence()
        for t, w in zip(texts, want):
            got = seen.of(t).tolist()
            assert len(got) == len(set(got)) and set(got) == w
    only = np.zeros(1 << T.BUCKET_BITS, bool)
    only[list(want[3])[:4]] = True
    assert set(seen.of(texts[3], only).tolist()) == set(list(want[3])[:4])


def test_counts_and_ratios(spark):
    docs, labels = written_docs(60)
    rows = T.labelled(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    mine = [(t, dict((i, x) for i, _, x in labels)[i]) for i, t, *_ in docs if i % 3 and not is_held_out(i)]
    pos, neg = {}, {}
    for text, toxic in mine:
        for b in plain_buckets(text):
            side = pos if toxic else neg
            side[b] = side.get(b, 0) + 1
    assert {r.bucket: (r.pos, r.neg) for r in T.bucket_counts(rows).collect()} == {b: (pos.get(b, 0), neg.get(b, 0)) for b in {*pos, *neg}}
    buckets, ratios = T.features(rows, 50)
    size = 1 << T.BUCKET_BITS
    for b, r in zip(buckets.tolist(), ratios):
        assert math.isclose(r, math.log((pos.get(b, 0) + 1) / (sum(pos.values()) + size) / ((neg.get(b, 0) + 1) / (sum(neg.values()) + size))), rel_tol=1e-9)


def test_logistic_fit_is_the_minimum():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 6, 200)
    at = np.concatenate([rng.choice(8, k, replace=False) for k in sizes])
    y, weight, r = rng.integers(0, 2, 200).astype(float), rng.integers(1, 5, 200).astype(float), rng.normal(size=8)
    w, b = T.fit_logistic(at, sizes, y, weight, r, 1e-2)
    x = np.zeros((200, 8))
    x[np.repeat(np.arange(200), sizes), at] = 1

    def loss(w, b):
        m = x @ w + b
        return (weight * (np.logaddexp(0, m) - y * m)).sum() / weight.sum() + 5e-3 * ((w / r) ** 2).sum()
    best = loss(w, b)
    assert all(loss(w + rng.normal(size=8) * 1e-2 * r, b + rng.normal() * 1e-2) > best - 1e-7 for _ in range(200))
