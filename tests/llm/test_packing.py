"""Packing: every piece in one place, no gaps, few sequences."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomsift.llm.common import documents, vocabulary
from loomsift.llm.packing import configurations, document_pieces, pack, pack_documents, plan_packing, sequences, stored
from loomsift.llm.common import written
from loomsift.llm.suite import queries
from loomsift.llm.tokens import WORD_BPE

VOCAB = vocabulary(WORD_BPE)


def places(counts, space):
    plan = plan_packing(counts, space)
    inside, numbers = defaultdict(list), defaultdict(set)
    for x, a, b, s, per, o in plan.table().tolist():
        for i in range(a, b):
            assert i not in numbers[x]
            numbers[x].add(i)
            inside[s + (i - a) // per].append((o + (i - a) % per * x, x))
    assert {x: set(range(n)) for x, n in counts.items() if n} == dict(numbers)
    assert set(inside) == set(range(plan.sequences))
    for parts in inside.values():
        end = 0
        for offset, x in sorted(parts):
            assert offset == end
            end += x
        assert end <= space
    return plan.sequences


@pytest.mark.parametrize("seed", range(25))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    space = int(rng.integers(3, 100))
    counts = Counter(rng.integers(1, space + 1, int(rng.integers(1, 800))).tolist())
    n = places(counts, space)
    assert n >= -(-sum(x * c for x, c in counts.items()) // space)
    # First fit decreasing, one piece at a time.
    bins = []
    for x in sorted(counts.elements(), reverse=True):
        i = next((i for i, left in enumerate(bins) if left >= x), None)
        if i is None:
            bins.append(space - x)
        else:
            bins[i] -= x
    assert n <= len(bins) * 1.02 + 1


def test_plan_corners():
    assert places({}, 2048) == 0 and places({2048: 5}, 2048) == 5 and places({1: 10000}, 2048) == 5
    assert places({1025: 7, 1023: 7}, 2048) == 7


def test_plan_does_not_grow_with_counts():
    rng = np.random.default_rng(0)
    counts = Counter(np.minimum(2048, rng.lognormal(6, 1, 20000).astype(int) + 1).tolist())
    small, large = plan_packing(counts), plan_packing({x: n * 10**9 for x, n in counts.items()})
    assert len(large.runs) < 2 * len(small.runs) + 4000
    assert large.sequences <= 1.01 * sum(x * n for x, n in counts.items()) * 10**9 / 2048 + 1


def test_configurations_reach_the_optimum():
    # Two of 5 and one of 3 fill 13; the programme must find mixed sequences.
    times = configurations([5, 3], [20, 10], 13)
    assert sum(t for _, t in times) == pytest.approx(10)


def pieces_of(rows, size=2048):
    library = Tokenizer.from_file(VOCAB)
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), size)):
            part = ids[a:a + size]
            out.append((doc_id, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def checked(rows, size=2048):
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr), len(inside)


def test_op1_whole_table(spark, sf):
    rows, n = checked(queries()["op1_best_fit_packing"](spark, sf).collect())
    assert rows == pieces_of([(r.doc_id, r.text) for r in documents(spark, sf).collect()])
    assert n <= -(-sum(r[3] for r in rows) // 2048) * 1.02 + 1


def test_op1_odd(spark, odd_docs, no_docs, wide):
    rows, _ = checked(pack_documents(wide(odd_docs), VOCAB, 64).collect(), 64)
    assert rows == pieces_of([(r.doc_id, r.text) for r in odd_docs.collect()], 64)
    assert pack_documents(no_docs, VOCAB).collect() == []


def test_sequences_hold_the_ids(spark, odd_docs):
    packed = written(pack(stored(document_pieces(odd_docs, VOCAB, 64, 0, True)), 64), "q")
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in sequences(packed).collect()}
    for r in packed.collect():
        assert zlib.crc32(whole[r.sequence_id][r.offset:r.offset + r.length].tobytes()) == r.ids_crc32
