"""The pipeline against sequential versions of its stages."""

import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from loomsift.llm.common import documents, vocabulary
from loomsift.llm.quality import PIECE_BPE, measure, piece_words
from loomsift.llm.secrets import masked, secret_spans
from loomsift.llm.suffixes import cut_passages
from loomsift.llm.tokens import WORD_BPE
from test_packing import checked
from test_quality import brute as quality
from test_simhash import brute_keep
from test_suffixes import brute as passages


class Row:
    def __init__(self, doc_id, text):
        self.doc_id, self.text = doc_id, text


def sequential(rows):
    pieces = piece_words(vocabulary(PIECE_BPE))
    rows = [r for r in rows if not quality(r.text)[5] and measure(r.text or "", pieces)[6]]
    rows = [Row(d, t) for d, t in brute_keep(rows)]
    cuts = {}
    for d, start, n, _, _ in passages(rows):
        cuts.setdefault(d, []).append((start, start + n))
    rows = [Row(r.doc_id, cut_passages(r.text, cuts[r.doc_id]) if r.doc_id in cuts else r.text) for r in rows]
    rows = [r for r in rows if re.search(r"[^\x20\x09-\x0D]", r.text)]
    return [Row(r.doc_id, masked(r.text, secret_spans(r.text))) for r in rows]


def test_run(spark, sf):
    library = Tokenizer.from_file(vocabulary(WORD_BPE))
    want = []
    for r in sequential(documents(spark, sf).collect()):
        ids = library.encode(r.text, add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a:a + 2048], "<u4")
            want.append((r.doc_id, p, a, len(part), zlib.crc32(part.tobytes())))
    rows, n = checked(corpus_pipeline.run(spark, sf).collect())
    assert rows == sorted(want, key=repr) and want
    assert n <= -(-sum(r[3] for r in rows) // 2048) * 1.05 + 1


def test_rows_decide_not_ids(spark):
    """Shared ids, repeated rows and copies without ids through the whole pipeline."""
    rng = random.Random(4)
    common = [w for r in documents(spark, "/root/testdata/sf0.001").where("lang = 'en'").limit(40).collect() for w in r.text.split() if w.isalpha()]
    a, b, c, d = (" ".join(rng.choice(common) for _ in range(80)) + "." for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (7, c), (None, d), (None, d), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted([(1, a), (5, b), (7, c), (None, d)], key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 4


def test_stages(spark, odd_docs, no_docs, wide):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]
    for docs in (wide(odd_docs), no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
