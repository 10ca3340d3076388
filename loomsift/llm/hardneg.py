"""Hard negatives by Fagin's threshold algorithm.

Candidates lie in blocks; a block holds their integer vectors and, for every dimension,
their order along it.  For an anchor the lists are read from the end that its sign
favours, all dimensions to the same depth.  Every candidate met for the first time is
scored in full (random access).  The anchor's product with the values at the current
depth is the threshold: no candidate that no list has shown yet can score higher.  A
block is left as soon as the threshold is strictly below the k-th score of every open
window (at equality an unseen candidate could tie and have a smaller id), or below the
window itself.

First the windows are found: an anchor's best rows of its own label.  Then the best rows
of other labels inside each window.  Blocks and anchors are files in the shared folder;
a task owns some anchors and streams a span of blocks, so its memory depends on neither.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.common import written
from loomsift.llm.files import fetch, make_dir, store
from loomsift.session import shared_dir

POSITIVES = 5
NEGATIVES = 3
EVERY = 50
SCALE = 256
#: Per cent of the positive's score that a negative must reach, and may not exceed.
LOW, HIGH = 50, 95
BLOCK_NUMBERS = 1 << 18
ANCHORS = 256
FIRST_DEPTH = 16


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y`` of integers, exact: in doubles or 64 bits where these suffice, else in Python's integers."""
    top = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[-1])
    if top < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    return x @ y if top < 1 << 63 else x.astype(object) @ y.astype(object)


class Block:
    """Candidates with their order along every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, labels=self.labels, x=self.x, order=self.order)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: pa.Buffer) -> Block:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            for name in parts.files:
                setattr(self, name, parts[name])
        return self


class Best:
    """The ``k`` best (score, id) inside a window of scores; ties to the smaller id."""

    def __init__(self, k: int, positive: int | None = None, low: int = LOW, high: int = HIGH):
        self.k, self.positive, self.low, self.high = k, positive, low, high
        self.score = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if self.positive is not None:
            times = 100 * (score if np.abs(score).max(initial=0) < 1 << 56 else score.astype(object))
            inside = ((times >= self.low * self.positive) & (times <= self.high * self.positive)).astype(bool)
            score, ids = score[inside], ids[inside]
        if len(score):
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, -score))[:self.k]
            self.score, self.ids = score[first], ids[first]

    def closed(self, threshold: int) -> bool:
        """No row of this score or less can enter any more."""
        if len(self.ids) == self.k and threshold < self.score[-1]:
            return True
        return self.positive is not None and 100 * threshold < self.low * self.positive


def threshold_scan(block: Block, anchor: np.ndarray, allowed: np.ndarray, windows: list[Best]) -> int:
    """Offer the block's allowed candidates to the windows until none can enter; returns how many were scored."""
    m = len(block.ids)
    seen = ~allowed
    dims = np.flatnonzero(anchor)
    weight = anchor[dims]
    up = weight > 0
    scored = depth = 0
    step = FIRST_DEPTH

    def bound(at: int) -> int:
        """The anchor's product with the values at this depth, each list read from its best end."""
        rows = np.where(up, block.order[dims, m - 1 - at], block.order[dims, at])
        return int(product(block.x[rows, dims], weight))

    if not len(dims):  # every score is zero and no list has a better end
        fresh = np.flatnonzero(allowed)
        for window in windows:
            window.add(np.zeros(len(fresh), np.int64), block.ids[fresh])
        return len(fresh)
    threshold = bound(0)
    while depth < m and not all(w.closed(threshold) for w in windows):
        take = min(step, m - depth)
        met = np.zeros(m, bool)
        met[block.order[dims[up], m - depth - take:m - depth].ravel()] = True
        met[block.order[dims[~up], depth:depth + take].ravel()] = True
        fresh = np.flatnonzero(met & ~seen)
        seen |= met
        if len(fresh):
            score = product(block.x[fresh], anchor).astype(np.int64)  # an overflow fails here
            for window in windows:
                window.add(score, block.ids[fresh])
            scored += len(fresh)
        depth += take
        step *= 2
        threshold = bound(depth - 1)
    return scored


# --- the job -------------------------------------------------------------------

def integer_rows(vectors: DataFrame, key: str, label: str, column: str, scale: int) -> DataFrame:
    """vec_id, label and the integer vector x of the rows that take part, one for each vec_id."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.when(F.abs(c * scale) < 9e18, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit("a component does not fit a long")).cast("long")))
    rows = (vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(column).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("v") > 0)))
    least = rows.select("vec_id", F.struct(whole.alias("x"), "label").alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    return least.select("vec_id", "r.label", "r.x")


def _matrix(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    starts = column.offsets.to_numpy()[:-1][rows]
    return column.values.to_numpy()[starts[:, None] + np.arange(dim)]


def _blocks(paths: list[str]) -> Iterator[Block]:
    """The stored blocks, small ones put together up to the size of a block."""
    held: list[Block] = []
    for path in [*paths, None]:
        block = None if path is None else Block.from_bytes(fetch(path))
        if held and (block is None or sum(b.x.size for b in held) + block.x.size > BLOCK_NUMBERS):
            yield held[0] if len(held) == 1 else Block(*(np.concatenate([getattr(b, n) for b in held]) for n in ("ids", "labels", "x")))
            held = []
        if block is not None:
            held.append(block)


def _stored_blocks(rows: DataFrame, count: int, folder: str) -> DataFrame:
    """Candidate blocks in files: dim and path."""
    def task(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}
        done = []

        def flush(dim: int) -> None:
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            path = f"{folder}/c-{uuid.uuid4().hex}.blk"
            store(path, Block(ids, labels, x).to_bytes())
            done.append((dim, path))

        for batch in batches:
            ids, labels, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                most = max(1, BLOCK_NUMBERS // dim)
                for k in range(0, len(at), most):
                    some = at[k:k + most]
                    mine = held.setdefault(dim, [])
                    if mine and sum(len(i) for i, _, _ in mine) + len(some) > most:
                        flush(dim)
                        mine = held.setdefault(dim, [])
                    mine.append((ids[some], labels[some], _matrix(lists, some, dim)))
        for dim in list(held):
            flush(dim)
        if done:
            dims, paths = zip(*done, strict=True)
            yield pa.record_batch([pa.array(dims, pa.int32()), pa.array(paths)], names=["dim", "path"])

    return written(rows.repartition(max(1, count), "vec_id").mapInArrow(task, "dim int, path string"), "candidate-blocks")


def _spans(blocks: DataFrame, spans: int, folder: str) -> DataFrame:
    """The blocks dealt into spans: dim and the path of a file that lists the span's blocks."""
    def task(batches: Iterator[pa.RecordBatch]):
        names: dict[int, list[str]] = {}
        for batch in batches:
            for dim, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.setdefault(dim, []).append(path)
        for dim, paths in names.items():
            listing = f"{folder}/s-{uuid.uuid4().hex}.txt"
            store(listing, "\n".join(sorted(paths)).encode())
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([listing])], names=["dim", "listing"])

    return written(blocks.repartition(spans, "path").mapInArrow(task, "dim int, listing string"), "block-spans")


def _lanes(rows: DataFrame, count: int, folder: str) -> DataFrame:
    """Rows of anchors in files of at most ``ANCHORS``: dim and lane (the path)."""
    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for k in range(0, len(at), ANCHORS):
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, batch.schema) as w:
                        w.write_batch(batch.take(pa.array(at[k:k + ANCHORS])))
                    path = f"{folder}/a-{uuid.uuid4().hex}.arrow"
                    store(path, out.getvalue().to_pybytes())
                    yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([path])], names=["dim", "lane"])

    return written(rows.repartition(max(1, count), "vec_id").mapInArrow(task, "dim int, lane string"), "anchor-lanes")


def _scanned(lanes: DataFrame, spans: DataFrame, k: int, same: bool, low: int, high: int) -> DataFrame:
    """The best ``k`` of each span for every anchor (same label) or for every window of an anchor (other labels)."""
    tasks = lanes.count() * spans.count()
    grid = lanes.join(spans, "dim").select("lane", "listing").repartition(max(1, tasks))

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lane, listing in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                anchors = pa.ipc.open_stream(fetch(lane)).read_all().to_pylist()
                vectors = [np.array(a["x"], np.int64) for a in anchors]
                windows = [[Best(k)] if same else [Best(k, w["score"], low, high) for w in a["windows"]] for a in anchors]
                for block in _blocks(fetch(listing).to_pybytes().decode().split("\n")):
                    for a, x, mine in zip(anchors, vectors, windows, strict=True):
                        allowed = (block.labels == a["label"]) & (block.ids != a["vec_id"]) if same else block.labels != a["label"]
                        threshold_scan(block, x, allowed, mine)
                out = [(a["vec_id"], None if same else p["id"], None if same else p["score"], int(i), int(s))
                       for a, mine in zip(anchors, windows, strict=True)
                       for p, best in zip([None] if same else a["windows"], mine, strict=True)
                       for s, i in zip(best.score, best.ids, strict=True)]
                if out:
                    names = ["anchor_id", "positive_id", "positive_score", "id", "score"]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return grid.mapInArrow(task, "anchor_id long, positive_id long, positive_score long, id long, score long")


def hard_negatives(vectors: DataFrame, key: str = "vec_id", label: str = "label", column: str = "embedding", scale: int = SCALE,
                   every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor and positive, the best rows of other labels scoring ``low`` to ``high`` per cent of the positive.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    Anchors are rows whose id is divisible by ``every``; their positives are the best
    rows of their label.  Components become ``floor(scale * x)`` and scores are exact
    inner products; ties go to the smaller id.

    Left out: rows with a null id, label or vector, an empty vector, or a null or
    non-finite component.  Of rows that repeat an id the one of smallest vector, then
    label, counts.  Only vectors of the anchor's own length are its candidates.  An
    anchor without positives, or a window that holds nothing, has no rows; an empty
    table gives none.  Scores or components that do not fit a long fail the job.
    """
    spark = vectors.sparkSession
    rows = written(integer_rows(vectors, key, label, column, scale), "integer-vectors")
    size = rows.agg(F.max(F.size("x")).alias("dim"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    folder = make_dir(shared_dir(spark, "hard-negatives"))
    blocks = _stored_blocks(rows, math.ceil(size.n * (size.dim or 1) / BLOCK_NUMBERS), folder)
    asked = rows.where(F.col("vec_id") % every == 0)
    count = math.ceil(size.anchors / ANCHORS)
    spans = _spans(blocks, max(1, min(blocks.count(), math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, count)))), folder)

    own = _scanned(_lanes(asked, count, folder), spans, positives, True, low, high)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("windows"))
    lanes = _lanes(asked.join(windows, "vec_id").select("vec_id", "label", "x", "windows"), count, folder)

    found = _scanned(lanes, spans, negatives, False, low, high)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e, label) AS k FROM v) WHERE k = 1),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM u a JOIN u c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
