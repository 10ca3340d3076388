"""Language-model scores of whole documents.

1. Word counts over all training documents, by 64-bit hash of the word.
2. The most frequent words form the lexicon of a gated recurrent model with a
   class-factored softmax.  It is trained by truncated backpropagation on every training
   document: each task makes one pass over its share from the common model, and the
   models are averaged by tokens; the first round sees a quarter of the documents, the
   second the rest.
3. Every document is scored with the state carried through it.  A word outside the
   lexicon counts as its class times its smoothed share among such words, so unseen
   words have a probability too.

The counts of frequent words (``KNOWN`` of them, whatever the corpus) go to every task;
those of rare words, whose number grows with the corpus, are joined to the few rare
words of each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm import gru
from loomsift.llm.common import doc_texts, documents, worker_table, written
from loomsift.llm.gru import LEXICON, RARE, Model, Trainer

#: Words whose counts every task holds (bounded); the lexicon are the first of them.
KNOWN = 1 << 16
#: Hash that stands for the end of a text; words are never empty.
END = 0
#: Tokens that are hashed at a time in a task, and that the model takes at a time: enough for even lanes beside a long text.
TOKENS = 1 << 20
MODEL_TOKENS = 1 << 22
CELLS = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id):
    """crc32 of the doc_id as text (null: empty text) leaves 2 by 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class WordHashes(dict):
    """Hash of each lower-cased word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) or 1
        return h

    def text(self, text: str) -> np.ndarray:
        """Hashes of the words and the end."""
        words = text.encode().translate(_LOWER).split()
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out.view(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash) and c over all texts; tasks count about TOKENS words at a time."""
    def task(batches: Iterator[pa.RecordBatch]):
        for _, hashes in _groups(batches, 0):
            words, n = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.record_batch([pa.array(words), pa.array(n)], names=["word", "c"])

    return texts.select("text").mapInArrow(task, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words (sorted by hash) with counts and lexicon numbers, and totals of the corpus."""

    words: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    total: int
    distinct: int
    rare_total: int
    rare_distinct: int

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def targets(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.numbers[place], RARE) if len(self.words) else np.full(len(place), RARE)


def least_count(counts: DataFrame, known: int) -> int:
    """The least count for which at most ``known`` words occur that often.

    Histograms find it: of the counts' bit lengths, then of 4,096 bins within the one
    where the number is passed.  What the driver sees is a few thousand bins, and no task
    sends a list of words.
    """
    bits = F.length(F.bin("c"))
    above = least = 0
    for r in counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).orderBy(F.desc("bits")).collect():
        if above + r.n > known:
            low, width = 1 << r.bits - 1, max(1, (1 << r.bits - 1) // 4096)
            bins = counts.where(bits == r.bits).groupBy(F.floor((F.col("c") - low) / width).alias("bin")).agg(F.count("*").alias("n"))
            least = low * 2
            for q in bins.orderBy(F.desc("bin")).collect():
                above += q.n
                if above > known:
                    break
                least = low + q.bin * width
            return least
        above += r.n
    return least


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = sorted(counts.where(F.col("c") >= least_count(counts, KNOWN)).collect(), key=lambda r: (-r.c, r.word))
    words = np.array([r.word for r in top], np.int64)
    c = np.array([r.c for r in top], np.int64)
    numbers = np.minimum(np.arange(len(top)), RARE)
    order = np.argsort(words)
    in_lexicon = int(c[:LEXICON].sum())
    return Vocabulary(words[order], c[order], numbers[order], sums.n, sums.v, sums.n - in_lexicon, sums.v - min(LEXICON, len(top)))


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows and their word hashes, about TOKENS at a time."""
    rows, hashes, size = [], [], 0
    table = worker_table("word hashes", WordHashes)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = table.text(row[column])
            rows.append(row[:column] + row[column + 1:])
            hashes.append(h)
            size += len(h)
            if size >= TOKENS:
                yield rows, hashes
                rows, hashes, size = [], [], 0
    if rows:
        yield rows, hashes


READY = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, targets binary, lost array<long>")


def prepared(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """Every text as targets of the model, with its sums over frequent words and the hashes of its rare ones.

    Written once; training and scoring read it instead of the texts.  ``row`` is a number of its own for each row.
    """
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def task(batches):
        v = sent.value
        known = np.append(v.counts, 0).astype(np.float64)
        base = np.log10((known + 1) / (v.total + v.distinct + 1))
        rare = np.log10((known + 1) / (v.rare_total + v.rare_distinct + 1))
        part, number = TaskContext.get().partitionId() << 40, 0
        for rows, hashes in _groups(batches, 2):
            size = np.array([len(h) for h in hashes])
            flat = np.concatenate(hashes)
            place = v.look_up(flat)
            targets = v.targets(place).astype("<u2")
            owner = np.repeat(np.arange(len(rows)), size)
            seen = place >= 0
            sums = [np.bincount(owner, w, len(rows)) for w in (seen, np.where(seen, base[place], 0), np.where(seen & (targets == RARE), rare[place], 0))]
            ends = np.concatenate([[0], np.cumsum(size)]) * 2
            lost = np.concatenate([[0], np.cumsum(np.bincount(owner[~seen], minlength=len(rows)))]).astype(np.int32)
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(targets)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part + number + np.arange(len(rows))), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
                 pa.array(size), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), binary,
                 pa.ListArray.from_arrays(pa.array(lost), pa.array(flat[~seen]))], names=[f.split()[0] for f in READY.split(", ")])
            number += len(rows)

    return written(texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(task, READY), "prepared")


def _target_groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows and their targets, about MODEL_TOKENS at a time."""
    rows, targets, size = [], [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t = np.frombuffer(row[column], "<u2").astype(np.int32)
            rows.append(row[:column] + row[column + 1:])
            targets.append(t)
            size += len(t)
            if size >= MODEL_TOKENS:
                yield rows, targets
                rows, targets, size = [], [], 0
    if rows:
        yield rows, targets


def train_round(ready: DataFrame, model: np.ndarray) -> np.ndarray:
    """One pass over the rows by every task from the same model; the token-weighted average of their models.

    The models travel in cells of a fixed number of weights and are summed in two steps,
    so no task takes in more than a share of them.
    """
    start = ready.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        mine = Model.from_flat(start.value)
        trainer = Trainer(mine)
        tokens = 0
        for _, targets in _target_groups(batches, 0):
            tokens += gru.train(mine, targets, trainer)[1]
        if tokens:
            flat = mine.flat().astype(np.float64) * tokens
            part = TaskContext.get().partitionId()
            for cell in range(-(-len(flat) // CELLS)):
                yield pa.record_batch([pa.array([cell]), pa.array([part % 32]), pa.array([float(tokens)]),
                                       pa.array([flat[cell * CELLS:(cell + 1) * CELLS].astype(np.float32).tobytes()])], names=["cell", "lane", "n", "w"])

    def add(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            for cell, lane, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = sums.setdefault((cell, lane), [0.0, 0.0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(w, np.float32).astype(np.float64)
        for (cell, lane), (n, w) in sums.items():
            yield pa.record_batch([pa.array([cell]), pa.array([lane]), pa.array([n]), pa.array([w.astype(np.float32).tobytes()])], names=["cell", "lane", "n", "w"])

    kinds = "cell long, lane long, n double, w binary"
    lanes = ready.select("targets").mapInArrow(task, kinds).repartition("cell", "lane").mapInArrow(add, kinds)
    cells = sorted(lanes.select("cell", F.lit(0).cast("long").alias("lane"), "n", "w").repartition("cell").mapInArrow(add, kinds).collect(), key=lambda r: r.cell)
    if not cells:
        return model
    return np.concatenate([np.frombuffer(r.w, np.float32) / r.n for r in cells]).astype(np.float32)


def train_model(ready: DataFrame, words: Vocabulary) -> np.ndarray:
    """The model after two rounds over all rows that are not held out."""
    order = np.argsort(words.numbers, kind="stable")
    counts = words.counts[order][words.numbers[order] < RARE]
    model = gru.start_model(counts, words.rare_total).flat()
    first = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    for share in (first, ~first):
        model = train_round(ready.where(~F.col("held_out") & share), model)
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Texts whose crc32(doc_id) leaves 2 by 7 are held out, the others are learnt from.
    Scores are log10 probabilities of all words and the end.  A null text is empty; a
    null doc_id counts as an empty one; repeated rows are scored (and learnt) each.  With
    nothing to learn from all words are unseen; an empty table gives no rows.
    """
    texts = doc_texts(docs)
    counts = written(word_counts(texts.where(~held_out(F.col("doc_id")))), "word-counts")
    words = vocabulary_of(counts)
    ready = prepared(texts, words)
    weights = docs.sparkSession.sparkContext.broadcast(train_model(ready, words))

    def task(batches):
        model = Model.from_flat(weights.value)
        for rows, targets in _target_groups(batches, 1):
            yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array(gru.score(model, targets) / np.log(10))], names=["row", "model"])

    scored = ready.select("row", "targets").mapInArrow(task, "row long, model double")
    # Rare words: their counts by join, then two sums for each document.
    lost = ready.select("row", F.explode("lost").alias("word"))
    c = F.coalesce(F.col("c"), F.lit(0))
    found = lost.join(counts, "word", "left").groupBy("row").agg(
        F.sum((c > 0).cast("long")).alias("known"), F.sum(F.log10((c + 1) / F.lit(float(words.total + words.distinct + 1)))).alias("more_base"),
        F.sum(F.log10((c + 1) / F.lit(float(words.rare_total + words.rare_distinct + 1)))).alias("more"))
    zero = F.lit(0.0)
    rows = ready.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare")
    return rows.join(scored.hint("merge"), "row").join(found.hint("merge"), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("model") + F.col("rare") + F.coalesce("more", zero)).alias("score"))


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
