"""Repeated passages by sparse suffix arrays.

A passage is repeated when at least ``MIN_WORDS`` consecutive words equal an earlier
passage: one in a document of smaller doc_id, or further ahead in the same document.

1. Every window of that many words selects the suffix at its minimiser, the run of
   ``RUN`` words of least hash within it.  The choice depends on the window's words
   alone, so equal windows select equal suffixes; about one position in twenty is kept.
2. Suffixes are gathered by their first words and sorted.  Each carries its extensions:
   the windows that reach left of the minimiser as far as they still hold it, and right
   to the window's end.  Sorted neighbours with equal extensions are equal passages; the
   first one stays, the others are repeats of it.
3. Extensions on one diagonal (same distance between repeat and first place) join into
   maximal passages.

Of first words that more than ``HOT`` suffixes share, the suffixes are first dealt into
shares by document; each share folds equal windows, and only the windows it saw first go
on, dealt by their content.  So neither copies nor many different surroundings of one
phrase gather in a task.  A row that repeats as a whole leaves each task once.  Windows are
compared by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.common import documents, give_back, row_hash, slices, worker_table, written

MIN_WORDS = 50
RUN = 12
HOT = 1000
#: Suffixes compared at a time in a task; groups are never cut.
CHUNK = 10_000
#: Windows that leave a task at a time.
BATCH_WINDOWS = 200_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = _POWERS[int(base)] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, base)]), dtype=np.uint64)
    return have[:n]


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes."""
    n = len(words)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_INVERSE, n), dtype=np.uint64)])
    out = (sums[size:] - sums[:-size]) * _powers(_BASE, n - size + 1)
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every ``size`` neighbours, from running minima of blocks."""
    n = len(values)
    pad = -n % size
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - size + 1], ahead[size - 1:n])


def sparse_suffixes(text: str, min_words: int = MIN_WORDS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the selected suffixes, the first window of each (and the end), and the hashes of all windows."""
    words = text.encode().split()
    if len(words) < min_words:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    table = worker_table("suffix words", _Hashes)
    hashes = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    windows = run_hashes(hashes, min_words)
    least = sliding_min(run_hashes(hashes, run), min_words - run + 1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[starts], np.concatenate([starts, [len(windows)]]), windows


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a row identity (repeated rows share it) and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("-")), text).alias("rid"), text.alias("text"))


_PLACE = [("doc_id", pa.int64()), ("rid", pa.int64()), ("at", pa.int32()), ("first_doc", pa.int64()), ("first_rid", pa.int64()),
          ("first_at", pa.int32()), ("n", pa.int32())]
_FIRST = [("key", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary()), ("windows", pa.binary())]
_FOLDED = pa.schema(_PLACE + _FIRST)
PLACE = "doc_id long, rid long, at int, first_doc long, first_rid long, first_at int, n int"
FOLDED = f"{PLACE}, key long, bucket int, places binary, windows binary"
_LAST = np.iinfo(np.int64).max


def _suffixes(keyed: DataFrame, min_words: int, run: int, payload: bool) -> DataFrame:
    """key[, doc_id, rid, at, windows] of all selected suffixes."""
    def packed(held: list[tuple]) -> pa.RecordBatch:
        keys, sizes, windows, doc_ids, rids, ats = zip(*held, strict=True)
        columns = [pa.array(np.concatenate(keys).view(np.int64))]
        if payload:
            n = [len(k) for k in keys]
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32) * 8
            doc = np.repeat(np.array([_LAST if d is None else d for d in doc_ids], np.int64), n)
            columns += [pa.array(doc, pa.int64(), mask=doc == _LAST), pa.array(np.repeat(np.array(rids, np.int64), n)), pa.array(np.concatenate(ats).astype(np.int32)),
                        pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(windows))])]
        return pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "rid", "at", "windows"][:len(columns)])

    def task(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        seen: set[int] = set()
        for batch in slices(batches):
            for doc_id, rid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rid in seen:  # a repeated row leaves a task once
                    continue
                seen.add(rid)
                keys, starts, windows = sparse_suffixes(text, min_words, run)
                if not len(keys):
                    continue
                held.append((keys, np.diff(starts), windows if payload else None, doc_id, rid, starts[:-1]))
                size += len(windows)
                if size >= BATCH_WINDOWS:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    kinds = "key long" + ", doc_id long, rid long, at int, windows binary" * payload
    return keyed.mapInArrow(task, kinds)


def _again(window: np.ndarray, place: np.ndarray, doc: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal an earlier one, and the first of each, by position in the arrays."""
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    inside = np.zeros(len(order), bool)
    inside[1:] = same
    inside[:-1] |= same
    some = order[inside]
    if not len(some):
        return some, some
    some = some[np.lexsort((place[some], rid[some], doc[some], window[some]))]
    w = window[some]
    fresh = np.concatenate([[True], w[1:] != w[:-1]])
    first = some[np.maximum.accumulate(np.where(fresh, np.arange(len(some)), 0))]
    again = (rid[first] != rid[some]) | (place[first] != place[some])  # a repeated row is no other place
    some, first = some[again], first[again]
    order = np.argsort(some)
    return some[order], first[order]


def _runs(some: np.ndarray, first: np.ndarray, place: np.ndarray, doc: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
    """Repeated windows in runs along a diagonal."""
    new = np.concatenate([[True], (rid[some[1:]] != rid[some[:-1]]) | (place[some[1:]] != place[some[:-1]] + 1)
                          | (rid[first[1:]] != rid[first[:-1]]) | (place[first[1:]] != place[first[:-1]] + 1)])
    begin = np.flatnonzero(new)
    n = np.diff(np.concatenate([begin, [len(some)]]))
    some, first = some[begin], first[begin]

    def ids(v):
        return pa.array(v, pa.int64(), mask=v == _LAST)

    columns = [ids(doc[some]), pa.array(rid[some]), pa.array(place[some].astype(np.int32)), ids(doc[first]), pa.array(rid[first]),
               pa.array(place[first].astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(n), t) for _, t in _FIRST], schema=_FOLDED)


def _firsts(key: np.ndarray, bucket: np.ndarray, row: np.ndarray, window: np.ndarray, place: np.ndarray, doc: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
    """Windows of hot suffixes that their share saw first, by suffix and bucket."""
    order = np.lexsort((bucket, row))
    row, bucket, window, place = row[order], bucket[order], window[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
    ends = np.concatenate([begin, [len(row)]])
    n, r = len(begin), row[begin]

    def binary(values: np.ndarray) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    places = [pa.array(doc[r], pa.int64(), mask=doc[r] == _LAST), pa.array(rid[r])] + [pa.nulls(n, t) for _, t in _PLACE[2:]]
    return pa.RecordBatch.from_arrays([*places, pa.array(key[r]), pa.array(bucket[begin].astype(np.int32)), binary(place.astype(np.int32)), binary(window)],
                                      schema=_FOLDED)


def _by_group(batches: Iterator[pa.RecordBatch], columns: tuple[str, str]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            a, b = (batch.column(batch.schema.names.index(c)).to_numpy() for c in columns)
            other = np.flatnonzero((a != a[-1]) | (b != b[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
                rows = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().fill_null(_LAST if name == "doc_id" else 0).to_numpy()


def _flat(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column side by side, and the number in each row."""
    data = table[name].to_pylist()
    return np.frombuffer(b"".join(data), kind), np.fromiter(map(len, data), np.int64, len(data)) // np.dtype(kind).itemsize


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes: repeated windows of each share of a group, and what a hot share saw first."""
    give_back()
    for table in _by_group(batches, ("key", "share")):
        window, size = _flat(table, "windows", np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        place = _numbers(table, "at").astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        doc, rid = _numbers(table, "doc_id")[row], _numbers(table, "rid")[row]
        shares, share = _numbers(table, "shares"), _numbers(table, "share")
        some, first = _again(window ^ (share.astype(np.uint64) * _MIX)[row], place, doc, rid)
        if len(some):
            yield _runs(some, first, place, doc, rid)
        fresh = (shares > 1)[row]
        fresh[some] = False
        at = np.flatnonzero(fresh)
        if len(at):
            bucket = (window[at] >> np.uint64(16)) % shares[row[at]].astype(np.uint64)
            yield _firsts(_numbers(table, "key"), bucket, row[at], window[at], place[at], _numbers(table, "doc_id"), _numbers(table, "rid"))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the shares of a hot group saw first, by content: repeated windows."""
    give_back()
    for table in _by_group(batches, ("key", "bucket")):
        window, size = _flat(table, "windows", np.uint64)
        place = _flat(table, "places", np.int32)[0].astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        doc, rid = _numbers(table, "doc_id")[row], _numbers(table, "rid")[row]
        some, first = _again(window, place, doc, rid)
        if len(some):
            yield _runs(some, first, place, doc, rid).select([n for n, _ in _PLACE])


def _repeats(keyed: DataFrame, min_words: int, run: int, hot: int) -> DataFrame:
    counts = _suffixes(keyed, min_words, run, False).groupBy("key").agg(F.count("*").alias("c"))
    crowded = written(counts.where(F.col("c") > hot).select("key", F.ceil(F.col("c") / max(hot, 1)).cast("int").alias("shares")), "hot-suffixes")
    dealt = _suffixes(keyed, min_words, run, True).join(crowded, "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = dealt.withColumn("share", F.pmod("rid", "shares").cast("int")).select("key", "share", "shares", "doc_id", "rid", "at", "windows")
    folded = written(dealt.repartition("key", "share").sortWithinPartitions("key", "share").mapInArrow(_fold, FOLDED), "folded")
    firsts = folded.where("key IS NOT NULL").select("key", "bucket", "doc_id", "rid", "places", "windows")
    met = firsts.repartition("key", "bucket").sortWithinPartitions("key", "bucket").mapInArrow(_meet, PLACE)
    found = folded.where("key IS NULL").select(*(n for n, _ in _PLACE)).union(met)
    lane = Window.partitionBy("rid", "first_rid", "step").orderBy("at")
    island = lane.rowsBetween(Window.unboundedPreceding, 0)
    return (found.withColumn("step", F.col("at") - F.col("first_at")).withColumn("end", F.col("at") + F.col("n"))
            .withColumn("new", F.coalesce(F.col("at") > F.lag("end").over(lane), F.lit(True)).cast("int"))
            .withColumn("passage", F.sum("new").over(island))
            .groupBy("rid", "first_rid", "step", "passage")
            .agg(F.min("doc_id").alias("doc_id"), F.min("first_doc").alias("first_doc_id"), F.min("at").alias("start_word"),
                 (F.max("end") - F.min("at") + (min_words - 1)).cast("int").alias("n_words"), F.min("first_at").alias("first_word"))
            .select("doc_id", "rid", "start_word", "n_words", "first_doc_id", "first_word"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, run: int = RUN, hot: int = HOT) -> DataFrame:
    """One row per repeated passage: doc_id, start_word, n_words, and an earlier place of it (first_doc_id, first_word).

    That is the first place, but for words of hot groups an earlier one in the same share.
    Documents without repeats have no row.  A null text is empty; null doc_ids come
    after all others; documents of equal doc_id are ordered by a hash; rows repeated as a
    whole are one document.  Words are what stands
    between ASCII blanks.
    """
    return _repeats(_keyed(docs), min_words, run, hot).select("doc_id", "start_word", "n_words", "first_doc_id", "first_word")


def cut_passages(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these (first word, end) spans."""
    out, at, n = [], 0, 0
    spans = sorted(spans)
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    k = 0
    for m in WORD.finditer(text):
        if k == len(merged):
            break
        if n == merged[k][0]:
            out.append(text[at:m.start()])
        n += 1
        if n == merged[k][1]:
            at = m.end()
            k += 1
    return "".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, run: int = RUN, hot: int = HOT) -> DataFrame:
    """All columns of the documents with repeated passages cut out of ``text``.

    The first place of each passage stays.  ``n_chars``, where present, is set anew on
    changed rows; a document of which no word is left is dropped.  Of rows that repeat
    doc_id and text one stays.
    """
    spans = (_repeats(_keyed(docs), min_words, run, hot).groupBy("rid")
             .agg(F.collect_list(F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("end"))).alias("__spans")).withColumnRenamed("rid", "__span_rid"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rid = F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), text)
    # Repeats are cut to one in every task before they meet; the join keeps that partitioning.
    again = Window.partitionBy("__rid").orderBy(row_hash(docs))
    once = docs.withColumn("__rid", rid).withColumn("__n", F.row_number().over(again)).where("__n = 1")
    joined = once.join(spans, F.col("__rid") == F.col("__span_rid"), "left").select(*docs.columns, "__spans")
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    width = len(docs.columns)

    def cut(batches):
        give_back()
        for batch in slices(batches):
            texts, spans = batch.column(at).to_pylist(), batch.column(width).to_pylist()
            new = [t if not s else cut_passages(t, [(x["start_word"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns[:width])
            schema = pa.schema([batch.schema.field(i) for i in range(width)])
            columns[at] = pa.array(new, schema.field(at).type)
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([len(b) if s else o for o, b, s in zip(old, new, spans, strict=True)], schema.field(count).type)
            keep = pa.array([not s or bool(b and WORD.search(b)) for b, s in zip(new, spans, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(keep)

    return joined.mapInArrow(cut, docs.schema)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
