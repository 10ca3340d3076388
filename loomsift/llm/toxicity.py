"""Toxicity by a character n-gram classifier with naive Bayes log-count ratios.

1. Texts are lower-cased, white space becomes a space; an n-gram of each of ``SIZES``
   characters is a bucket of 2**20.  A document's feature is whether it holds the bucket.
2. Counts of documents by bucket and label, over all labelled training rows, give each
   bucket's ratio ``r = log((p / |p|) / (q / |q|))``, with one added to every count.
3. The ``KEPT`` buckets that tell most about the label (log-likelihood ratio of presence)
   are the features, each worth ``r`` where present.
4. A logistic regression on these features is fitted on at most about ``FIT_TEXTS``
   distinct labelled texts, chosen by a hash of the text, copies as weights; below that
   number on all of them.
5. Every whole text of the table is scored with the weights.

Only ``KEPT`` rows reach the driver.  Texts cross the network once, those of training
rows on their way to their labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import documents, written

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 20
KEPT = 1024
FIT_TEXTS = 20_000
#: Least number of documents that hold a feature.
LEAST_DOCS = 3
PENALTY = 1e-3
THRESHOLD = 0.3
CHUNK_CHARS = 1 << 20

_TIMES = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the text, repeats included, some at a time."""
    padded = f" {text.lower()} ".encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(padded, "<u4")
    longest = max(SIZES)
    for first in range(0, len(codes), CHUNK_CHARS):
        part = codes[first:first + CHUNK_CHARS + longest - 1]
        part = np.where(part <= 32, np.uint32(32), part)
        h = part * _TIMES
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            h = (h[:len(part) - n + 1] ^ part[n - 1:]) * _TIMES
            if n in SIZES:
                yield ((h[:CHUNK_CHARS] ^ (h[:CHUNK_CHARS] >> np.uint32(15))) * _MIX >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


class Presence:
    """Distinct buckets of one text after the other, by marks in a table."""

    def __init__(self):
        self.mark = np.full(1 << BUCKET_BITS, -1, np.int64)
        self.next = 0

    def of(self, text: str, only: np.ndarray | None = None) -> np.ndarray:
        """Each bucket of the text once; of these only those flagged in ``only``."""
        begin = self.next
        out = []
        for buckets in grams(text):
            if only is not None:
                buckets = buckets[only[buckets]]
            buckets = buckets[self.mark[buckets] < begin]
            at = np.arange(self.next, self.next + len(buckets))
            self.mark[buckets] = at  # of repeats the last one stays
            out.append(buckets[self.mark[buckets] == at])
            self.next += len(buckets)
        return np.concatenate(out) if out else np.empty(0, np.int64)


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learnt from; a null id is no training row and not held out."""
    return ~held_out(doc_id) & F.col(doc_id).isNotNull()


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """hash, toxic and text of the training rows that have a label (of several the largest), written."""
    marks = (labels.where(F.col("toxic").isNotNull() & in_training()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    texts = docs.where(in_training()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # One small row for each id: the side that a partition holds as a table.
    joined = texts.join(marks.hint("shuffle_hash"), "doc_id")
    return written(joined.select(F.xxhash64("text").alias("hash"), "toxic", "text"), "labelled")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Documents that hold each bucket, by label: bucket, pos, neg."""
    def task(batches: Iterator[pa.RecordBatch]):
        seen = Presence()
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[toxic, seen.of(text.as_py())] += 1
        held = np.flatnonzero(counts.any(0))
        for at in range(0, len(held), 50_000):
            some = held[at:at + 50_000]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(counts[1, some]), pa.array(counts[0, some])], names=["bucket", "pos", "neg"])

    out = rows.select("toxic", "text").mapInArrow(task, "bucket int, pos long, neg long")
    return out.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def features(rows: DataFrame, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features and their log-count ratios, in the order of bucket."""
    counts = written(bucket_counts(rows), "bucket-counts")
    docs = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos"), F.count("*").alias("n")).first()
    sums = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    if not docs.pos or docs.pos == docs.n or sums.pos is None:
        return np.empty(0, np.int64), np.empty(0)
    n_pos, n_neg = docs.pos, docs.n - docs.pos
    share = (F.col("pos") + F.col("neg")) / F.lit(docs.n)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    told = (part(F.col("pos"), n_pos * share) + part(F.col("neg"), n_neg * share)
            + part(n_pos - F.col("pos"), n_pos * (1 - share)) + part(n_neg - F.col("neg"), n_neg * (1 - share)))
    ratio = F.log((F.col("pos") + 1) / F.lit(float(sums.pos + (1 << BUCKET_BITS)))) - F.log((F.col("neg") + 1) / F.lit(float(sums.neg + (1 << BUCKET_BITS))))
    best = (counts.where(F.col("pos") + F.col("neg") >= LEAST_DOCS).select("bucket", ratio.alias("r"), F.round(told, 6).alias("told"))
            .orderBy(F.desc("told"), "bucket").limit(kept).collect())
    best = sorted((r.bucket, r.r) for r in best)
    return np.array([b for b, _ in best], np.int64), np.array([r for _, r in best])


def fit_logistic(at: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, r: np.ndarray, penalty: float = PENALTY,
                 rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights (times ``r``) and intercept of a penalised logistic regression, by L-BFGS.

    ``at`` are the features of all rows side by side, ``sizes`` how many each row has.
    """
    share = weight / weight.sum()
    row = np.repeat(np.arange(len(sizes)), sizes)

    def look(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.bincount(row, (w[:-1] * r)[at], len(sizes)) + w[-1]
        off = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
        loss = float(share @ (np.logaddexp(0, margin) - y * margin)) + penalty / 2 * float(w[:-1] @ w[:-1])
        slope = np.append(np.bincount(at, (share * off)[row], len(r)) * r + penalty * w[:-1], share @ off)
        return loss, slope

    w = np.zeros(len(r) + 1)
    loss, slope = look(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way = -slope
        found = []
        for s, g in reversed(past):
            a = s @ way / (s @ g)
            found.append(a)
            way = way - a * g
        if past:
            way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]))
        for (s, g), a in zip(past, reversed(found), strict=True):
            way = way + s * (a - g @ way / (s @ g))
        step = 1.0 if past else 1 / max(1.0, float(np.abs(slope).sum()))
        while True:
            after, fresh = look(w + step * way)
            if after <= loss + 1e-4 * step * float(slope @ way) or step < 1e-10:
                break
            step /= 2
        s, g = step * way, fresh - slope
        done = loss - after < 1e-9
        w, loss, slope = w + s, after, fresh
        if done:
            break
        if s @ g > 1e-14:
            past = [*past, (s, g)][-10:]
    return w[:-1] * r, float(w[-1])


def fit(rows: DataFrame, buckets: np.ndarray, r: np.ndarray, texts: int = FIT_TEXTS) -> tuple[np.ndarray, float]:
    """The regression on at most about ``texts`` distinct labelled texts."""
    number = np.full(1 << BUCKET_BITS, -1, np.int32)
    number[buckets] = np.arange(len(buckets))
    distinct = rows.groupBy("hash", "toxic").agg(F.count("*").alias("n"))
    many = distinct.count()
    some = rows.where(F.pmod(F.col("hash"), F.lit(1 << 31)) < int((1 << 31) * min(1.0, texts / max(1, many))))

    def present(batches: Iterator[pa.RecordBatch]):
        seen = Presence()
        flags = number >= 0
        for batch in batches:
            for h, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                at = np.sort(number[seen.of(text.as_py(), flags)]).astype("<u2")
                yield pa.record_batch([pa.array([h]), pa.array([toxic], pa.int32()), pa.array([at.tobytes()], pa.binary())], names=["hash", "toxic", "at"])

    def learn(batches: Iterator[pa.RecordBatch]):
        parts, sizes, y, weight = [], [], [], []
        for batch in batches:
            for toxic, n, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(np.frombuffer(at, "<u2"))
                sizes.append(len(parts[-1]))
                y.append(toxic)
                weight.append(n)
        w, b = fit_logistic(np.concatenate(parts), np.array(sizes), np.array(y, float), np.array(weight, float), r)
        yield pa.record_batch([pa.array([w.tolist()]), pa.array([b])], names=["w", "b"])

    kept = (some.select("hash", "toxic", "text").mapInArrow(present, "hash long, toxic int, at binary").groupBy("hash", "toxic")
            .agg(F.count("*").alias("n"), F.min("at").alias("at")).repartition(1).sortWithinPartitions("hash", "toxic"))
    model = kept.select("toxic", "n", "at").mapInArrow(learn, "w array<double>, b double").first()
    return np.array(model.w), model.b


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``docs``.

    A null text is empty; a text without a feature gets the score of the intercept.  A
    null doc_id stays null, is not held out and has no label.  Of an id's labels the
    largest counts, null labels do not.  Without training rows of both labels every
    score is the share of label 1 (0 without any).  An empty table gives no rows.
    Copies score equally; columns beyond doc_id and text are not read.
    """
    rows = labelled(docs, labels)
    buckets, r = features(rows)
    table = np.zeros(1 << BUCKET_BITS)
    if len(buckets):
        weights, base = fit(rows, buckets, r)
        table[buckets] = weights
    else:
        share = rows.agg(F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("share")).first().share
        base = float("inf") if share == 1 else float("-inf")
    held = docs.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]):
        weight = held.value
        flags = weight != 0
        seen = Presence()
        for batch in batches:
            margin = np.array([weight[seen.of(text.as_py(), flags)].sum() + base for text in batch.column(2)], float)
            with np.errstate(over="ignore"):
                value = 1 / (1 + np.exp(-margin))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
