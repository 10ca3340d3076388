"""Token files and packing against whole-library encodings and sequential counts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomsift.llm.common import documents, vocabulary
from loomsift.llm.eliasfano import EliasFano, pack
from loomsift.llm.suite import queries
from loomsift.llm.tokenfiles import TokenFile, file_bytes, read_token_files, token_output, write_token_files
from loomsift.llm.tokens import WORD_BPE, BpeWords


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary(WORD_BPE))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n,top", [(0, 5), (1, 10**12), (2, 3), (700, 90), (3000, 10**9), (70000, 1 << 20)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(-5, top, n))
    data = pack(v)
    ef = EliasFano(b"xx" + data, 2)
    assert ef.end == len(data) + 2 and ef.values().tolist() == v.tolist()
    for i in {0, n // 2, n - 1} | set(range(0, n, 487)):
        if 0 <= i < n:
            assert ef.select(i) == v[i]
    with pytest.raises(IndexError):
        ef.select(n)
    if n > 1000:
        assert 8 * len(data) < n * (3 + max(1, np.log2((top + 6) / n)) + 1) + 64 * n / 512 + 800


def test_token_file_round_trip():
    ids = [np.array(x, np.uint32) for x in ([1, 2, 70000], [], [5], [6, 7])]
    f = TokenFile(file_bytes([None, 3, 3, 9], ids))
    assert [f.doc_id(i) for i in range(4)] == [None, 3, 3, 9]
    assert [f.tokens(i).tolist() for i in range(4)] == [x.tolist() for x in ids]


def test_words_equal_library(library):
    words = BpeWords(vocabulary(WORD_BPE), limit=50)
    rng = random.Random(1)
    chars = "aAbÉéßüÄ ıİΣσ'sSt'. ,<|endoftext|>& ́\x1c\x00 ９日本語\n\t\r\x0b\x85İ😀１²'reǄﬁŉſ"
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 15))) + rng.choice(["", "<|endoftext|>b"])
        assert words.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def expected_tokens(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=repr)


def test_op3_whole_table(spark, sf, library):
    assert got(queries()["op3_token_files"](spark, sf)) == expected_tokens(documents(spark, sf).collect(), library)


def test_op3_odd(spark, odd_docs, no_docs, wide, library):
    assert got(token_output(wide(odd_docs), vocabulary(WORD_BPE))) == expected_tokens(odd_docs.collect(), library)
    assert token_output(no_docs, vocabulary(WORD_BPE)).collect() == []


def test_op3_small_files(spark, odd_docs, tmp_path):
    manifest = write_token_files(odd_docs, str(tmp_path), vocabulary(WORD_BPE), file_ids=5)
    rows = manifest.collect()
    assert len(rows) >= 4 and sum(r.n_docs for r in rows) == odd_docs.count()
    assert all(r.n_ids <= 5 or r.n_docs == 1 for r in rows)
    parts = read_token_files(manifest).rdd.glom().map(len).collect()
    # A task for every file (files of equal range never share one).
    assert len(parts) == len(rows) and sorted(parts) == sorted(r.n_docs for r in rows)


@pytest.mark.parametrize("n,nulls", [(0, 0), (3, 3), (1500, 0), (1500, 700)])
def test_documents_by_blocks(n, nulls):
    rng = np.random.default_rng(n)
    ids = [rng.integers(0, 60000, rng.integers(0, 9)).astype(np.uint32) for _ in range(n)]
    names = [None] * nulls + sorted(rng.integers(-50, 10**6, n - nulls).tolist())
    f = TokenFile(file_bytes(names, ids))
    for size in (512, 4096):
        got = list(f.documents(size))
        assert [d for d, _, _ in got] == names and [x.tolist() for _, _, x in got] == [x.tolist() for x in ids]
        assert [a for _, a, _ in got] == [f.bounds.select(i) for i in range(n)]
