"""Sampled segmentations: lossless, reproducible, and as likely as enumeration says."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomsift.llm.common import documents, vocabulary
from loomsift.llm.lattice import SPACE, Lattices, Pieces, decode_ids, encode_samples, row_key, sampled, sampled_digests
from loomsift.llm.quality import PIECE_BPE
from loomsift.llm.suite import queries

VOCAB = vocabulary(PIECE_BPE)


@pytest.fixture(scope="module")
def lattices():
    return Lattices(Pieces(VOCAB))


def every(pieces, part):
    """All segmentations of a part of known characters with their weights."""
    if not part:
        yield (), 1.0
    for end in range(1, len(part) + 1):
        if part[:end] in pieces.id:
            number, weight = pieces.id[part[:end]]
            for rest, w in every(pieces, part[end:]):
                yield (number, *rest), weight * w


def test_lossless(lattices):
    rng = random.Random(1)
    chars = "ab e\n\t  ▁é日\0\r😀ß.,\x01﻿ the ing "
    texts = ["", " ", "  a", "a  ", "▁", " ▁ ▁▁", "\0", "the thing", "x" * 3000]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    ids = sampled(lattices, texts, [row_key(i, 1) for i in range(len(texts))])
    assert [lattices.pieces.decode(x.tolist()) for x in ids] == texts


def test_distribution(lattices):
    word = "there"
    want = dict(every(lattices.pieces, SPACE + word))
    total = sum(want.values())
    n = 40000
    got = Counter(tuple(x.tolist()) for x in sampled(lattices, [word] * n, [row_key(i, 3) for i in range(n)]))
    assert set(got) <= set(want) and len(got) > 5
    chi = sum((got[s] - n * w / total) ** 2 / (n * w / total) for s, w in want.items() if n * w / total > 5)
    assert chi < 4 * sum(n * w / total > 5 for w in want.values()) + 40


def test_parts_are_drawn_apart(lattices):
    text = " ".join(["there"] * 400)
    (ids,) = sampled(lattices, [text], [5])
    words = Counter(tuple(x) for x in np.split(ids, np.flatnonzero([lattices.pieces.bytes_of[i].startswith(b" ") for i in ids])[1:]))
    assert len(words) > 3


def test_keys_alone_decide(lattices):
    texts = ["the same thing in another place", "and one more of them", ""]
    keys = [row_key(i, 1) for i in range(3)]
    together = [x.tolist() for x in sampled(lattices, texts, keys)]
    fresh = Lattices(Pieces(VOCAB), limit=1)
    alone = [sampled(fresh, [t], [k])[0].tolist() for t, k in reversed(list(zip(texts, keys)))][::-1]
    assert together == alone
    assert together != [x.tolist() for x in sampled(lattices, texts, [row_key(i, 2) for i in range(3)])]


def test_op4_whole_table(spark, sf):
    rows = {r.doc_id: r for r in queries()["op4_sentencepiece_sampling"](spark, sf).collect()}
    docs = documents(spark, sf).collect()
    assert len(rows) == len(docs) and all(r.lossless for r in rows.values())
    fresh = Lattices(Pieces(VOCAB))
    for d in docs[::20]:
        (ids,) = sampled(fresh, [d.text], [row_key(d.doc_id, 1)])
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))


def test_op4_odd(spark, odd_docs, no_docs, wide):
    docs = wide(odd_docs)
    one, other = encode_samples(docs, VOCAB), encode_samples(docs.repartition(5), VOCAB)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr)
    back = sorted(map(tuple, decode_ids(one, VOCAB).collect()), key=repr)
    assert back == sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=repr)
    assert all(r.lossless for r in sampled_digests(docs, VOCAB).collect()) and sampled_digests(no_docs, VOCAB).collect() == []


def test_forward_sums_meet_a_plain_loop():
    """Shares of every edge, for parts filtered side by side; long parts are scaled on the way."""
    pieces = Pieces(VOCAB)
    found = Lattices(pieces)
    rng = random.Random(3)
    parts = [SPACE + "there", "x", "日本", "e" * 900, *("".join(rng.choice("theansingo,é日") for _ in range(rng.randint(1, 30))) for _ in range(200))]
    parts = list(dict.fromkeys(parts))
    found.add(parts[:50])
    found.add(parts[50:])
    first = [*found.first, len(found.shares)]
    for part in parts:
        logs = [0.0]
        for j in range(1, len(part) + 1):
            edges = [(i, *pieces.id[part[i:j]]) for i in range(max(0, j - pieces.longest), j) if part[i:j] in pieces.id]
            if part[j - 1] not in pieces.id:
                edges.append((j - 1, pieces.symbol_of_char(part[j - 1]), 1.0))
            sums = np.logaddexp.accumulate([logs[i] + np.log(w) for i, _, w in edges])
            logs.append(sums[-1])
            node = found[part] - len(part) + j
            at = slice(first[node], first[node + 1])
            assert list(found.symbol[at]) == [s for _, s, _ in edges]
            assert list(found.before[at]) == [found[part] - len(part) + i if i else -1 for i, _, _ in edges]
            assert np.allclose(found.shares[at], np.exp(sums - sums[-1]), rtol=1e-9) and found.shares[at][-1] == 1.0
