"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are stored in blocks: 8-bit codes, the step and the exact length of each
rounding error, beside the vectors themselves.  A task owns one block of queries and a
span of candidate blocks, which it streams.  The product of two code blocks is exact in
integers; with the error lengths it bounds every inner product from both sides.  Pairs
whose upper bound is below the k-th best found so far are passed over, the rest are
computed again in double precision and merged into the queries' heaps.  The bounds are
sure, so the result is exact.
"""

from __future__ import annotations

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

NEAREST = 20
EVERY = 20
#: Numbers in a stored block, at most; and rows of a tile side.
BLOCK_NUMBERS = 1 << 20
TILE = 1024


class Block:
    """Vectors of one length with their codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        top = np.abs(vectors).max(1)
        self.step = np.where(top > 0, top / 127.0, 1.0)
        self.codes = np.rint(vectors / self.step[:, None]).astype(np.int8)
        near = self.codes * self.step[:, None]
        # A hair more than the exact lengths, so that rounding here never makes a bound too tight.
        self.error = np.sqrt(((vectors - near) ** 2).sum(1)) * (1 + 1e-9) + top * 1e-14
        self.size = np.sqrt((vectors ** 2).sum(1)) * (1 + 1e-9)
        self.near_size = np.sqrt((near ** 2).sum(1)) * (1 + 1e-9)

    def to_bytes(self) -> bytes:
        out = pa.BufferOutputStream()
        columns = {"ids": self.ids, "vectors": self.vectors.ravel(), "codes": self.codes.ravel(), "step": self.step,
                   "error": self.error, "size": self.size, "near_size": self.near_size}
        batch = pa.record_batch([pa.ListArray.from_arrays([0, len(v)], pa.array(v)) for v in columns.values()], names=list(columns))
        with pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)
        return out.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, data: pa.Buffer) -> Block:
        self = cls.__new__(cls)
        batch = pa.ipc.open_stream(data).read_next_batch()
        for name in batch.schema.names:
            setattr(self, name, batch.column(name).values.to_numpy())
        self.vectors = self.vectors.reshape(len(self.ids), -1)
        self.codes = self.codes.reshape(len(self.ids), -1)
        return self


class Heaps:
    """The best ``k`` (score, id) of each query; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.ids = np.empty(0, np.int64)
        self.least = np.full(n, -np.inf)

    def merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[rank < self.k]
        self.query, self.score, self.ids = query[rank < self.k], score[keep], ids[keep]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[self.query[last]] = self.score[last]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added from the first component to the last: equal vectors score equally."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def join_tile(queries: Block, candidates: Block, heaps: Heaps) -> int:
    """Merge the candidates of one block into the heaps; returns the number of exact products."""
    wide = np.float32 if queries.codes.shape[1] <= 1000 else np.float64  # integers stay exact
    exact = 0
    for q in range(0, len(queries.ids), TILE):
        qs = slice(q, q + TILE)
        left = queries.codes[qs].astype(wide)
        for c in range(0, len(candidates.ids), TILE):
            cs = slice(c, c + TILE)
            near = (left @ candidates.codes[cs].astype(wide).T) * (queries.step[qs, None] * candidates.step[None, cs])
            slack = queries.error[qs, None] * candidates.size[None, cs] + queries.near_size[qs, None] * candidates.error[None, cs]
            own = queries.ids[qs, None] == candidates.ids[None, cs]
            least = heaps.least[qs]
            fresh = np.flatnonzero(np.isneginf(least))
            if len(fresh) and near.shape[1] > heaps.k:
                # No k found yet: the k-th best lower bound of this tile will do.
                low = np.where(own[fresh], -np.inf, (near - slack)[fresh])
                least = least.copy()
                least[fresh] = np.partition(low, -heaps.k, axis=1)[:, -heaps.k]
            i, j = np.nonzero(~(near + slack < least[:, None]) & ~own)
            for at in range(0, len(i), 1 << 16):
                a, b = i[at:at + (1 << 16)] + q, j[at:at + (1 << 16)] + c
                heaps.merge(a, exact_scores(queries.vectors[a], candidates.vectors[b]), candidates.ids[b])
            exact += len(i)
    return exact


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id and vector (double) of the rows that take part, one for each vec_id.

    Left out: null ids, null, empty or all-zero vectors and vectors with null or
    non-finite components.  Of rows that repeat an id the smallest vector counts.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return (vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v")))


def _stored(rows: DataFrame, count: int, folder: str, side: str) -> DataFrame:
    """Blocks of the rows in files: dim, block (unique in the side) and path."""
    def task(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}
        out = []

        def flush(dim: int) -> None:
            ids, parts = zip(*held.pop(dim), strict=True)
            path = f"{folder}/{side}-{uuid.uuid4().hex}.blk"
            store(path, Block(np.concatenate(ids), np.concatenate(parts)).to_bytes())
            out.append((dim, path))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                part = max(1, BLOCK_NUMBERS // dim)
                for k in range(0, len(at), part):
                    some = at[k:k + part]
                    mine = held.setdefault(dim, [])
                    if mine and (sum(len(x) for x, _ in mine) + len(some)) * dim > BLOCK_NUMBERS:
                        flush(dim)
                        mine = held.setdefault(dim, [])
                    mine.append((ids[some], flat[starts[some][:, None] + np.arange(dim)]))
        for dim in list(held):
            flush(dim)
        if out:
            dims, paths = zip(*out, strict=True)
            yield pa.record_batch([pa.array(dims, pa.int32()), pa.array(paths)], names=["dim", "path"])

    return written(rows.repartition(max(1, count), "vec_id").mapInArrow(task, "dim int, path string"), f"blocks-{side}")


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` candidates of largest inner product for every query (id divisible by ``every``).

    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows
    where there are fewer candidates.  Only vectors of the query's own length are its
    candidates.  Rows that take no part are named in ``usable``; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, key, column), "vectors")
    dim = rows.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    per_block = max(1, BLOCK_NUMBERS // (dim.d or 1))
    folder = make_dir(shared_dir(spark, "vector-blocks"))
    asked = rows.where(F.col("vec_id") % every == 0)
    candidates = _stored(rows, math.ceil(dim.n / per_block), folder, "c")
    queries = _stored(asked, math.ceil(dim.n / every / per_block), folder, "q")
    lanes = queries.count()
    spans = max(1, min(candidates.count(), math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, lanes))))
    dealt = (candidates.withColumn("span", F.pmod(F.xxhash64("path"), F.lit(spans))).groupBy("dim", "span")
             .agg(F.sort_array(F.collect_list("path")).alias("paths")))
    grid = queries.join(dealt, "dim").select(F.col("path").alias("lane"), "paths").repartition(max(1, lanes * spans))

    def task(batches):
        for batch in batches:
            for lane, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = Block.from_bytes(fetch(lane))
                heaps = Heaps(len(mine.ids), k)
                for path in paths:
                    join_tile(mine, Block.from_bytes(fetch(path)), heaps)
                for at in range(0, len(heaps.query), 50_000):
                    s = slice(at, at + 50_000)
                    yield pa.record_batch([pa.array(mine.ids[heaps.query[s]]), pa.array(heaps.ids[s]), pa.array(heaps.score[s])],
                                          names=["query_id", "vec_id", "score"])

    found = grid.mapInArrow(task, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, min(e) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
