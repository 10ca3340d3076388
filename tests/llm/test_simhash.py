"""Fingerprints, links and components against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from loomsift.llm import simhash
from loomsift.llm.common import documents
from loomsift.llm.graph import components
from loomsift.llm.simhash import fingerprint, keep_one, near_duplicates, near_pairs
from loomsift.llm.suite import queries


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    near = {}
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    for d, p in prints:
        if d is not None:
            near[find(p)] = min(d, near.get(find(p), d))
    return sorted(((d, f"{p:016x}", near.get(find(p))) for d, p in prints), key=repr)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_op8_whole_table(spark, sf):
    assert got(queries()["op8_simhash"](spark, sf)) == brute(documents(spark, sf).collect())


def test_op8_odd(spark, odd_docs, no_docs, wide):
    assert got(near_duplicates(wide(odd_docs))) == brute(odd_docs.collect())
    assert near_duplicates(no_docs).collect() == []


def test_null_ids_link(spark, monkeypatch):
    # 0 - 3 bits - 7 - 3 bits - 63: the middle one has no doc_id.
    rows = [(5, 0), (None, 7), (3, 63), (None, 63), (9, 1 << 40 | 63), (None, 1 << 60 | 0xFFFF << 20), (8, 0xFFFF << 30)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: prints)
    want = [(5, 3), (None, 3), (3, 3), (None, 3), (9, 3), (None, None), (8, 8)]
    assert sorted(((r.doc_id, r.component_id) for r in near_duplicates(prints).collect()), key=repr) == sorted(want, key=repr)


def test_spark_hash_is_the_same(spark):
    texts = ["", "a", "the cat sat", "ünder naïve 日本", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert [r.h % 2**64 for r in rows] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("hot", [4096, 2])
def test_near_pairs(spark, hot):
    rng = random.Random(3)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    top = rng.getrandbits(32) << 32
    fps |= {top | rng.getrandbits(32) for _ in range(60)} | {top | 1 << i for i in range(32)} | {top}
    fps = sorted(fps)
    signed = [f - (f >> 63 << 64) for f in fps]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    rows = near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), hot).collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    nodes = rng.sample(range(-500, 500), 200)
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)] + list(zip(nodes[:60], nodes[1:61])) + [(nodes[0], n) for n in nodes[100:160]]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def meet(x, y):
    """Whether two signatures share a segment but for a bit, and 128 bits (fingerprint, next three segments) are close."""
    def more(segments, i):
        a, b, c = (segments[(i + k) % len(segments)] for k in (1, 2, 3))
        return (a | b << 24 | c << 48) % 2**64

    return any((s ^ t).bit_count() <= 1 and (x[0] ^ y[0]).bit_count() + (more(x[1], i) ^ more(y[1], i)).bit_count() <= simhash.WIDE_DISTANCE
               for i, (s, t) in enumerate(zip(x[1], y[1], strict=True)))


def brute_keep(rows):
    """Rows that stay: one of each group, row by row.  ``rows`` have doc_id and text; returns their (doc_id, text).

    Groups: fingerprints within 3 bits, and pairs of 5-word similarity 0.8 whose signatures meet.
    """
    texts = sorted({r.text or "" for r in rows})
    found = {t: simhash.signature(t) for t in texts}
    shingles = {t: five(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            apart = (found[a][0] ^ found[b][0]).bit_count()
            both = shingles[a] | shingles[b]
            if apart <= 3 or meet(found[a], found[b]) and len(shingles[a] & shingles[b]) >= 0.8 * len(both):
                root[find(a)] = find(b)

    def order(r):
        h = xxhash.xxh64_intdigest((r.text or "").encode(), 42)
        return r.doc_id is None, r.doc_id or 0, h - (h >> 63 << 64)

    best = {}
    for r in rows:
        group = find(r.text or "")
        if group not in best or order(r) < order(best[group]):
            best[group] = r
    return sorted(((r.doc_id, r.text) for r in best.values()), key=repr)


def pairs_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_keep_one(spark, odd_docs, wide):
    docs = wide(odd_docs)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    # 1, 2 and 6 have no words; the repeated row 4 stays once.
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, None, 5], key=repr)
    assert len(pairs_of(kept)) == len(brute_keep(odd_docs.collect()))
    assert keep_one(docs.limit(0)).collect() == []


def test_rows_are_judged_apart(spark):
    """A shared doc_id does not take a unique text along; repeated rows and copies without ids go."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in ("ash", "birch", "cedar", "date"))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (7, c, "x"), (7, c, "y"), (None, d, "x"), (None, d, "x"), (None, a, "x"), (None, b, "z")]
    got = sorted(((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (7, c), (None, d)], key=repr)


def test_a_third_is_one_row(spark):
    rng = random.Random(2)
    rows = [(3, "one and the same long row " * 5)] * 300 + [(None, "the row without a name " * 5)] * 300
    rows += [(100 + i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(50))) for i in range(300)]
    assert keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).count() == 302


@pytest.mark.parametrize("words", [60, 400])
def test_near_copies_of_four_fifths_are_found(spark, words):
    """Measured recall over pairs of 5-word similarity 0.8 and more; clean texts stay."""
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs = [], 0
    while pairs < 300:
        text = [rng.choice(vocabulary) for _ in range(words)]
        other = list(text)
        for _ in range(rng.randint(1, max(1, words // 40))):
            other[rng.randrange(words)] = rng.choice(vocabulary)
        x, y = five(" ".join(text)), five(" ".join(other))
        if len(x & y) >= 0.8 * len(x | y):
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
            pairs += 1
    clean = [(len(rows) + i, " ".join(rng.choice(vocabulary) for _ in range(words))) for i in range(300)]
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert kept >= {i for i, _ in clean} and kept >= {i for i, _ in rows[::2]}
    assert sum(i not in kept for i, _ in rows[1::2]) >= 0.9 * pairs


def test_similarity_from_sketches():
    rng = random.Random(1)
    for n in (3, 40, 200, 2000):
        words = [str(rng.randint(0, 10**6)) for _ in range(n)]
        other = [w if rng.random() > 0.03 else "new" for w in words]
        a, b = " ".join(words), " ".join(other)
        exact = len(five(a) & five(b)) / len(five(a) | five(b))
        near = simhash.similarity(simhash.signature(a)[2], simhash.signature(b)[2])
        assert near == exact if n <= 200 else abs(near - exact) < 0.12
    assert simhash.similarity(*[simhash.signature("")[2]] * 2) == 1.0


def test_short_and_long():
    assert fingerprint("") == 0 and fingerprint("A b") == brute_print("a B") == fingerprint(" a\tb\n")
    text = " ".join(str(i % 997) for i in range(30000))
    assert fingerprint(text) == brute_print(text)
