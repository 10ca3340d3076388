"""Helpers shared by the operators: inputs, written intermediates, hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.session import shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of every row, other columns only on request."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def row_hash(df: DataFrame):
    """A hash of the whole row, by which rows that agree in a key are ordered; maps and variants do not count."""
    return F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t and "variant" not in t))


_TABLE: dict = {}


def worker_table(key, make: Callable):
    """A table that a Python worker keeps between tasks, one at a time.

    A worker that goes on to another operator gives the last one's table back first.
    """
    if key not in _TABLE:
        give_back()
        _TABLE[key] = make()
    return _TABLE[key]


def give_back() -> None:
    """Drop the table that this worker keeps and return freed memory to the system.

    Called at the start of tasks that keep no table: a worker outlives the operator that filled it.
    """
    if not _TABLE:
        return
    _TABLE.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that fewer texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def arrow_rows(fn: Callable[[pa.RecordBatch], Iterator[tuple]], schema: pa.Schema, rows: int = 2000
               ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function of one that yields tuples for a batch; batches stay small."""
    def run(batches):
        out: list[tuple] = []
        for batch in batches:
            for row in fn(batch):
                out.append(row)
                if len(out) >= rows:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
