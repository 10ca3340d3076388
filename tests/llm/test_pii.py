"""Personal data: base spans against a plain scan, the estimates on made votes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomsift.llm.common import documents
from loomsift.llm.pii import BASE_KINDS, estimate, find_personal_data
from loomsift.llm.suite import queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c))))) for i, c in enumerate(reversed(d))) % 10 == 0


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d or "1"),
            "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k in BASE_KINDS for m in re.finditer(PATTERNS[k], text or "") if fine(k, m[0])]


def row(doc_id, text):
    spans = brute(text)
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    return (doc_id, *(sum(s[0] == k for s in spans) for k in BASE_KINDS), digest)


def base(rows):
    return sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows), key=repr)


def test_op6_whole_table(spark, sf):
    df = queries()["op6_personal_data"](spark, sf)
    assert base(df.collect()) == sorted((row(r.doc_id, r.text) for r in documents(spark, sf).collect()), key=repr)
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_op6_odd(spark, odd_docs, no_docs, wide):
    assert base(find_personal_data(wide(odd_docs)).collect()) == sorted((row(r.doc_id, r.text) for r in odd_docs.collect()), key=repr)
    assert find_personal_data(no_docs).collect() == []


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "x@y.com", ".", "-", "_", "1", "12", "255", "256", "0", "+", "+1", " ", "(555)", "4929", "4111 1111 1111 1111", "4111-1111-1111-1111",
            "é", "😀", "\n", "1.2.3.4", "._", "%", "5500005555555559", "00", "+44 20 7946 0958"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += ["a@b.c._x@d.e", "1.2.3.4.5.6.7.8", "0.0.0.0255", "1 " * 3000, "+1" * 2000, "a." * 5000 + "@b" + ".c" * 5000, "9" * 30000, "1.1." * 3000, "-1" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = find_personal_data(docs).collect()
    assert base(got) == sorted((row(i, t) for i, t in enumerate(texts)), key=repr)
    for r in got:
        assert {f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id])} <= set(r.spans.split(","))


def test_looser_spans(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    filler = lambda: " ".join(word() for _ in range(8))
    docs, want, never = [], {}, {}
    for i in range(400):
        number = f"{rng.randint(200, 899)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        kind = i % 4
        if kind == 0:
            text = f"{filler()} please call phone {number}. {filler()}"
            want[i] = number
        elif kind == 1:
            text = f"{filler()} see serial model part {number[:3]}-{number[4:7]}-{number[8:11]}x {filler()}"
        elif kind == 2:
            name = f"{rng.choice(['Mary', 'Hans', 'José'])} {word().capitalize()}"
            text = f"{filler()} contact Dr. {name}, {filler()}"
            want[i] = name
        else:
            text = f"{filler()} write to email {word()} [at] {word()} [dot] com now"
            want[i] = "[at]"
        docs.append((i, text))
    rows = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hit = 0
    for i, text in docs:
        found = [text[int(a):int(b)] for a, b in (s.split(":")[1:] for s in rows[i].split(",") if s)]
        if i in want:
            hit += any(want[i] in f for f in found)
        else:
            assert not found
    assert hit >= 0.95 * len(want)


def test_estimate_finds_the_reliable_labelers():
    rng = random.Random(0)
    counts, truth = {}, {}
    good = {True: (0.8, 0.05), False: (0.05, 0.8)}
    for _ in range(20000):
        y = rng.random() < 0.3
        votes = ""
        for j in range(5):
            plus, minus = good[y] if j < 3 else (0.3, 0.3)
            u = rng.random()
            votes += "+" if u < plus else "-" if u < plus + minus else "0"
        key = "phone|" + votes
        counts[key] = counts.get(key, 0) + 1
        truth[key] = truth.get(key, 0) + y
    belief, shares = estimate(counts)
    wrong = sum(min(n - truth[k], n) if belief[k] > 0.5 else truth[k] for k, n in counts.items())
    assert wrong < 0.08 * 20000
    assert abs(shares["form"]["+"][0] - 0.8) < 0.05 and abs(shares["cue"]["+"][0] - shares["cue"]["+"][1]) < 0.05
    assert estimate({}) == ({}, estimate({})[1])
