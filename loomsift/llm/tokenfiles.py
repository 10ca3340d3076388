"""Token-id files with Elias-Fano document boundaries, in ascending doc_id order.

A file holds one run of documents::

    "LSTF" version:int32  n_docs:int64  n_null:int64  n_ids:int64  width:int32  ids_at:int64
    Elias-Fano of the doc_ids that are not null (nulls stand first)
    Elias-Fano of the n_docs + 1 boundaries
    ids: unsigned little-endian, 2 bytes where every id fits, else 4

Offset ``i`` is ``select(i)`` on the boundaries; no table of offsets is stored.
Documents are dealt by doc_id range and sorted in each range; a task streams its range
into files of a bounded number of ids.  A file gets its final name only when complete,
with the attempt in it, and only the files in the manifest of finished tasks are read:
a retried task leaves no wrong rows, and what a failed attempt left is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.common import arrow_rows, doc_texts, written
from loomsift.llm.eliasfano import EliasFano, pack
from loomsift.llm.files import fetch, make_dir, store
from loomsift.llm.tokens import WORD_BPE, bpe_words
from loomsift.session import shared_dir

_HEAD = struct.Struct("<4siqqqiq")
FILE_IDS = 1 << 22
#: Boundaries decoded at a time when a file is read through; a multiple of the select step.
READ_BLOCK = 4096
END_ID = 2
MANIFEST = "part int, file int, path string, n_docs long, n_ids long"
READ = "part int, file int, at long, doc_id long, start long, n_tokens long, ids_crc32 long"


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file's bytes; null doc_ids first, the others not decreasing."""
    n_null = sum(d is None for d in doc_ids)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    names = pack(np.array(doc_ids[n_null:], np.int64))
    ends = pack(bounds)
    at = _HEAD.size + len(names) + len(ends)
    head = _HEAD.pack(b"LSTF", 1, len(doc_ids), n_null, int(bounds[-1]), width, at)
    return head + names + ends + flat.astype(f"<u{width}").tobytes()


class TokenFile:
    """Documents of one file's bytes, by position."""

    def __init__(self, data: bytes | memoryview):
        magic, version, self.n_docs, self.n_null, self.n_ids, width, at = _HEAD.unpack_from(data, 0)
        if magic != b"LSTF" or version != 1:
            raise ValueError("not a token file")
        self.names = EliasFano(data, _HEAD.size)
        self.bounds = EliasFano(data, self.names.end)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.names.select(i - self.n_null)

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)].astype(np.uint32)

    def documents(self, size: int = READ_BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the file and ids of every document in order; ``size`` boundaries are decoded at a time."""
        names = chain(repeat(None, self.n_null), (v for block in self.names.blocks(size) for v in block.tolist()))
        bounds = pairwise(v for block in self.bounds.blocks(size) for v in block.tolist())
        for doc_id, (a, b) in zip(names, bounds, strict=True):
            yield doc_id, a, self.ids[a:b]


def write_token_files(docs: DataFrame, folder: str, vocab: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every document, append ``end_id`` and write the files; returns the manifest.

    Rows of equal doc_id are ordered by text.  A null text is empty (its only id is
    ``end_id``), a null doc_id comes first.  A document longer than ``file_ids`` has a
    file for itself.  The folder must be one that every executor and the driver reach.
    """
    uri = make_dir(folder)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = bpe_words(vocab)
        context = TaskContext.get()
        part = context.partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = 0

        def flush() -> tuple:
            path = f"{uri}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.lst"
            store(path, file_bytes([d for d, _ in held], [x for _, x in held]))
            return part, number, path, len(held), size

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(words.encode(text), np.uint32(end_id))
                if held and size + len(ids) > file_ids:
                    yield flush()
                    held, size, number = [], 0, number + 1
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def task(batches):
        for row in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    ordered = doc_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(task, MANIFEST), "token-files")


def file_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each file: sums within a part, then over the parts (one row for each part)."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(base, "part").select("part", "file", "path", (F.col("base") + F.col("inside")).alias("file_start")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document read back: ``part``, ``file``, position ``at``, ``doc_id``,
    ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    Every file is read by a task of its own: the number given keeps small manifests apart.
    """
    def rows(batch):
        for part, number, path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i, (doc_id, start, ids) in enumerate(TokenFile(fetch(path)).documents()):
                yield part, number, i, doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()),
                        ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    dealt = file_starts(manifest).repartitionByRange(max(1, manifest.count()), "part", "file")
    return dealt.mapInArrow(arrow_rows(rows, schema), READ)


def token_output(docs: DataFrame, vocab: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all documents' ids and read them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in ascending doc_id order.
    An empty table gives no files and no rows; further columns of ``docs`` are not used.
    """
    folder = folder or shared_dir(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, folder, vocab, end_id)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    from loomsift.llm.common import documents, vocabulary

    return token_output(documents(spark, sf_dir), vocabulary(WORD_BPE))
