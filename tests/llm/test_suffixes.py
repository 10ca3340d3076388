"""Repeated passages against all windows."""

import random
import re

import numpy as np
import pytest
import xxhash

from loomsift.llm.common import documents
from loomsift.llm.suffixes import cut_passages, drop_repeats, repeated_passages, run_hashes, sliding_min
from loomsift.llm.suite import queries


def brute(rows, size=50):
    """(doc_id, start, n_words, first_doc, first_word) of maximal repeats along diagonals."""
    def rid(r):
        h = xxhash.xxh64_intdigest((r.text or "").encode(), xxhash.xxh64_intdigest("-" if r.doc_id is None else str(r.doc_id), 42))
        return h - (h >> 63 << 64)

    docs = sorted({(r.doc_id is None, r.doc_id or 0, rid(r), r.text or "") for r in rows})
    first, runs = {}, []
    for null, doc_id, _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        me = None if null else doc_id
        last = None
        for i in range(len(words) - size + 1):
            w = tuple(words[i:i + size])
            if w not in first:
                first[w] = (me, text, i)
                last = None
                continue
            f = first[w]
            if last and runs[-1][5] == f[1] and runs[-1][3] == f[0] and last == (i - 1, f[2] - 1):
                runs[-1][2] += 1
            else:
                runs.append([me, i, size, f[0], f[2], f[1]])
            last = (i, f[2])
    return sorted((tuple(r[:5]) for r in runs), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def passages(spark, seed, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(6)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        rows.append((d * 3 - 20 if d % 9 else None, " ".join(text)))
    rows += [rows[4], rows[7], (1000, rows[5][1]), (1001, "a b " * 40), (1002, None), (1003, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_small_windows(spark, seed):
    docs = passages(spark, seed)
    want = brute(docs.collect(), 12)
    assert want and got(repeated_passages(docs, 12, 4)) == want


@pytest.mark.parametrize("hot", [3, 20])
def test_hot_groups(spark, hot):
    docs = passages(spark, 4)
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates()
    words = {r.doc_id: (r.text or "").split() for r in rows.collect()}

    def covered(found):
        return {(d, i) for d, start, n, *_ in found for i in range(start, start + n)}

    found = got(repeated_passages(rows, 12, 4, hot))
    assert covered(found) == covered(brute(rows.collect(), 12)) and found
    for d, start, n, first, at in found:
        assert words[d][start:start + n] == words[first][at:at + n] and (first, at) < (d, start)


def test_op10_whole_table(spark, sf):
    want = brute(documents(spark, sf).collect())
    assert want and got(queries()["op10_suffix_dedup"](spark, sf)) == want


def test_op10_odd(spark, odd_docs, no_docs, wide):
    assert got(repeated_passages(wide(odd_docs))) == brute(odd_docs.collect())
    assert repeated_passages(no_docs).collect() == []
    assert drop_repeats(no_docs).collect() == []


def test_drop_repeats(spark, wide):
    body = [" ".join(f"p{k}w{i}" for i in range(70)) for k in range(3)]
    rows = [(1, f"head {body[0]}\n tail", 5), (2, f"other\t{body[0]} end", 5), (3, body[0], 5), (4, f"{body[1]} {body[2]}", 5), (5, f"x {body[2]} y {body[1]}", 5),
            (6, "clean text", 77), (7, None, None)]
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    out = drop_repeats(docs, 50)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {1: rows[0][1], 2: "other\t end", 4: rows[3][1], 5: "x  y ", 6: "clean text", 7: None}
    assert {r.doc_id: r.n_chars for r in out.collect()} == {1: 5, 2: 10, 4: 5, 5: 5, 6: 77, 7: None}


def test_cut():
    assert cut_passages(" a b c d ", [(1, 2), (2, 3)]) == " a  d " and cut_passages("a b", [(0, 2)]) == "" and cut_passages("a b", []) == "a b"


@pytest.mark.parametrize("n,size", [(5, 5), (100, 7), (1000, 39), (40, 39)])
def test_sliding_min(n, size):
    v = np.random.default_rng(n).integers(0, 50, n).astype(np.uint64)
    assert sliding_min(v, size).tolist() == [v[i:i + size].min() for i in range(n - size + 1)]


def test_run_hashes_follow_content():
    w = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    x = np.concatenate([w[:150], w[50:150], w[:50]])
    h = run_hashes(x, 20)
    assert (h[150:231] == h[50:131]).all() and len(set(h[:131].tolist())) == 131


def test_a_third_is_one_row(spark):
    """A repeated row leaves each task once and stays once; its passages stay too."""
    body = " ".join(f"w{i}" for i in range(90))
    rows = [(9, f"start {body}")] * 200 + [(20, f"other {body} end"), (None, f"last {body}")] + [(100 + i, f"alone {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(repeated_passages(docs, 50, 12, 5)) == sorted([(20, 1, 90, 9, 1), (None, 1, 90, 9, 1)], key=repr)
    out = drop_repeats(docs, 50).collect()
    assert len(out) == 203 and {r.doc_id: r.text for r in out if r.doc_id in (9, 20, None)} == {9: f"start {body}", 20: "other  end", None: "last "}
