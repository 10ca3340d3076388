"""Language model: gradients, base scores by brute force, gain on held-out documents."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomsift.llm import gru
from loomsift.llm.common import documents
from loomsift.llm.lm import score_documents
from loomsift.llm.suite import queries


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def brute(rows):
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count = Counter(w for r in rows if not out(r.doc_id) for w in tokens(r.text))
    n, v = sum(count.values()), len(count)
    return sorted(((r.doc_id, out(r.doc_id), len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
                   for r in rows for t in [tokens(r.text)]), key=repr)


def same(rows, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=lambda x: repr(x[:5]))
    want = sorted(want, key=lambda x: repr(x[:5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_op7_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["op7_language_model"](spark, sf).collect()
    same(rows, brute(documents(spark, sf).collect()))
    held = [r for r in rows if r.held_out]
    # The model must beat the counts on texts it has not seen.
    assert sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_op7_odd(spark, odd_docs, no_docs, wide):
    same(score_documents(wide(odd_docs)).collect(), brute(odd_docs.collect()))
    assert score_documents(no_docs).collect() == []
    alone = odd_docs.where("doc_id = 4").limit(1)
    same(score_documents(alone).collect(), brute(alone.collect()))


@pytest.fixture
def tiny(monkeypatch):
    for name, value in {"CLASSES": 3, "WORDS": 4, "HIDDEN": 5, "LEXICON": 12, "RARE": 12, "BEGIN": 13}.items():
        monkeypatch.setattr(gru, name, value)
    m = gru.start_model(np.arange(12, 0, -1), 9, kind=np.float64)
    rng = np.random.default_rng(1)
    for a in m.arrays():
        a += rng.normal(size=a.shape) * 0.3
    return m, rng


def test_gradients(tiny):
    m, rng = tiny
    inputs, targets = rng.integers(0, 14, (6, 4)), rng.integers(-1, 13, (6, 4))
    fresh = rng.random((6, 4)) < 0.2
    state = rng.normal(size=(5, 4))
    loss, n, (rows, table), rest, _ = gru.gradients(m, inputs, fresh, targets, state)
    assert n == (targets >= 0).sum()
    full = np.zeros_like(m.table)
    full[rows] = table
    for a, d in zip(m.arrays(), [full, *rest]):
        for i in rng.integers(0, a.size, 12):
            old = a.flat[i]
            a.flat[i] = old + 1e-6
            up = gru.gradients(m, inputs, fresh, targets, state)[0]
            a.flat[i] = old - 1e-6
            down = gru.gradients(m, inputs, fresh, targets, state)[0]
            a.flat[i] = old
            assert abs((up - down) / 2e-6 - d.flat[i]) < 1e-5


def test_probabilities_sum_to_one_and_state_is_carried(tiny):
    m, rng = tiny
    h = rng.normal(size=(3, 5))
    p = sum(np.exp(gru.log_probs(m, h, np.full(3, w))) for w in range(13))
    assert np.allclose(p, 1)
    texts = [rng.integers(0, 13, n) for n in (1, 70, 5, 33, 2)]

    def plain(text):
        state, given, out = np.zeros((5, 1)), 13, 0.0
        for i, w in enumerate(text):
            states, state, _ = gru.run_states(m, np.array([[given]]), np.array([[i == 0]]), state)
            out += gru.log_probs(m, states[0].T, np.array([w]))[0]
            given = w
        return out

    for lanes, steps in ((1, 7), (3, 4), (64, 16)):
        assert np.allclose(gru.score(m, texts, lanes, steps, 20), [plain(t) for t in texts])
