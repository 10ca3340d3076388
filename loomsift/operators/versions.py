"""Versions of the same output: change detection, diffs, session cache."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T
from loomsift.functions.text import let
from loomsift.operators.lines import chunk_prefix, islands, number_lines, require_keys
from loomsift.session import shared_dir


def content_version(runs: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str],
                    text: str = "raw") -> DataFrame:
    """Versions of every key's output: number, first seen, runs, hash."""
    hashed = runs.select(*key, chunk, *order, F.sha1(F.encode(F.col(text), "utf-8")).alias("hash"))
    found = islands(hashed, key, chunk, order, "hash", keep=[chunk]).drop("key") \
        .withColumnRenamed("line", "hash")
    return number_lines(found, key, chunk, order, "version").drop(chunk)


def with_previous(rows: DataFrame, stream: Sequence[str], chunk: str, order: Sequence[str],
                  columns: Sequence[str]) -> DataFrame:
    """Add ``prev_<column>`` of the row before in the stream, across chunks."""
    cols = F.struct(*columns)
    out = chunk_prefix(rows, stream, chunk, {"_last": F.max_by(cols, F.struct(*order))},
                       {"_before": F.last("_last")})
    inside = Window.partitionBy(*stream, chunk).orderBy(*order)
    prev = F.coalesce(F.lag(cols).over(inside), F.col("_before"))
    return out.withColumn("_prev", prev).withColumns(
        {f"prev_{c}": F.col("_prev")[c] for c in columns}).drop("_prev", "_before")


def snapshot_changes(old: Column, new: Column) -> Column:
    """Removed and added lines between two texts, as a multiset difference.

    Array of (sign, line, occurrence); a moved line is no change.  Lines with their
    occurrence are compared as strings, which takes one hash lookup each.
    """
    def keyed(text: Column) -> Column:
        return F.transform(A.with_occurrence(T.split_lines(text)), lambda r: F.concat(r["line"], F.lit("\0"), r["occurrence"].cast("string")))

    def signed(sign: str, keys: Column) -> Column:
        return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(
            F.substring(k, F.lit(1), F.length(k) - F.length(F.substring_index(k, "\0", -1)) - 1).alias("line"),
            F.substring_index(k, "\0", -1).cast("int").alias("occurrence")))), lambda r: F.struct(
                F.lit(sign).alias("sign"), r["line"].alias("line"), r["occurrence"].alias("occurrence")))

    return let(F.struct(keyed(old).alias("a"), keyed(new).alias("b")), lambda x: F.concat(
        signed("-", F.array_except(x["a"], x["b"])), signed("+", F.array_except(x["b"], x["a"]))))


def snapshot_diff(pairs: DataFrame, old: str = "old", new: str = "new",
                  max_lines: int = P.CACHE_DIFF_LINES) -> DataFrame:
    """Add ``changes`` (count) and ``diff``: the changed lines as ``-x`` / ``+x``.

    ``diff`` is null without changes or with more than ``max_lines`` of them.
    """
    rows = pairs.withColumn("_c", snapshot_changes(F.col(old), F.col(new)))
    n = F.size("_c")
    text = F.array_join(F.transform("_c", lambda c: F.concat(c["sign"], T.clip_line(c["line"]))), "\n")
    return rows.withColumn("changes", n.cast("bigint")) \
        .withColumn("diff", F.when((n > 0) & (n <= max_lines), text)).drop("_c")


def consecutive_pairs(rows: DataFrame, key: Sequence[str], version: str, text: str) -> DataFrame:
    """(old, new) texts of consecutive versions, by equality on the number."""
    new = rows.select(*key, F.col(version), F.col(text).alias("new"))
    old = rows.select(*key, (F.col(version) + 1).alias(version), F.col(text).alias("old"))
    return new.join(old, [*key, version])


# --- session cache: a prefix scan over range partitions ---------------------------

#: Kinds of rows between the two passes.
_FINAL, _PENDING, _SUMMARY = 0, 1, 2


@dataclass
class _Cache:
    """The cache after a run: key, content and second of that run, second of the stored entry."""

    key: int
    content: int
    t: int
    anchor: int


def _starts(keys: np.ndarray, contents: np.ndarray, t: np.ndarray, ttl: int) -> np.ndarray:
    """Rows but the first at which a segment starts: another key or content, or a gap that reaches the ttl."""
    return np.flatnonzero((keys[1:] != keys[:-1]) | (contents[1:] != contents[:-1]) | (t[1:] - t[:-1] >= ttl)) + 1


def _fold(keys: np.ndarray, contents: np.ndarray, t: np.ndarray, ttl: int, state: _Cache | None) -> tuple[np.ndarray, np.ndarray, _Cache]:
    """Status (0 new, 1 unchanged, 2 changed) and age of sorted runs after ``state``, and the state after them."""
    n = len(t)
    status, age = np.ones(n, np.int8), np.empty(n, np.int64)
    goes_on = state is not None and state.key == keys[0] and state.content == contents[0] and t[0] - state.t < ttl
    anchor = state.anchor if state is not None else 0
    before = state.key if state is not None else None
    edges = np.concatenate([[0], _starts(keys, contents, t, ttl), [n]])
    for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if i or not goes_on:
            # Only a change of content meets an entry that may be fresh.
            met = int(t[s]) - anchor if before == keys[s] else ttl
            changed = met < ttl
            status[s], age[s] = (2, met) if changed else (0, 0)
            anchor, first = int(t[s]), s + 1
        else:
            first = s
        while first < e:
            j = first + int(np.searchsorted(t[first:e], anchor + ttl, side="left"))
            age[first:j] = t[first:j] - anchor
            if j < e:
                status[j], age[j], anchor = 0, 0, int(t[j])
                j += 1
            first = j
        before = keys[s]
    return status, age, _Cache(int(keys[-1]), int(contents[-1]), int(t[-1]), anchor)


def _jumps(t: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one segment: its first seconds, as far as an entry from before it can reach, and for each
    the entry at the end of the segment when that second is stored."""
    seconds = np.unique(t)
    n = len(seconds)
    after = np.searchsorted(seconds, seconds + ttl, side="left")
    last = np.where(after < n, np.minimum(after, n - 1), np.arange(n))
    while True:  # pointers double until all stand still
        further = last[last]
        if (further == last).all():
            break
        last = further
    reach = int(np.searchsorted(seconds, seconds[0] + ttl, side="left")) + 1
    return seconds[:reach], seconds[last[:reach]]


def session_fold(runs: DataFrame, key: Sequence[str], order: Sequence[str], t: str = "t", content: str = "hash",
                 ttl: int = P.CACHE_TTL_SECONDS, previous: Sequence[str] = ()) -> DataFrame:
    """State of a session cache at every run: new, unchanged or changed.

    A run is *unchanged* when the stored entry has its content and is younger
    than ``ttl`` seconds; it then leaves the entry alone.  Any other run is
    stored, as *changed* when the old entry was still fresh, else as *new*.
    ``t`` is in whole seconds and the first of ``order``, ``age`` is the age of the
    entry met.  ``previous`` columns of the run before are returned as ``prev_<column>``.

    A prefix scan: runs are dealt and sorted by (key, order) ranges, so a key with a
    third of all runs is spread over many tasks, whatever its days.  Each range is
    folded at once; only its first segment hangs on what came before.  One summary a
    range, with the entry at its end (for a range of one segment as a short table of
    entries), is scanned in order, and the first segments are folded again with the
    state that the scan hands them.  A null key fails the job.
    """
    key, order, previous = list(key), list(order), list(previous)
    if order[0] != t:
        raise ValueError("the first order column must be the time")
    names = runs.columns
    kinds = dict(runs.dtypes)
    entered = require_keys(runs, key).select(*names, F.xxhash64(*key).alias("_k"), F.xxhash64(content).alias("_c"), F.col(t).cast("bigint").alias("_t"))
    spans = [f"`prev_{c}` {kinds[c]}" for c in previous]
    body = [f"`{c}` {kinds[c]}" for c in names] + ["status string", "age bigint", *spans]
    state = ["in_k bigint", "in_c bigint", "in_t bigint", "in_anchor bigint", *(f"`in_{c}` {kinds[c]}" for c in previous)]
    summary = ["first_k bigint", "first_c bigint", "first_t bigint", "anchor bigint", "seconds array<bigint>", "entries array<bigint>"]
    first_pass = ", ".join([*body, "_k bigint", "_c bigint", "_t bigint", "part int", "kind int", *summary])
    words = pa.array(["new", "unchanged", "changed"])
    number, numbers = pa.int64(), pa.list_(pa.int64())

    def typed(batch: pa.RecordBatch, more: Sequence[tuple[str, pa.DataType]] = ()) -> pa.Schema:
        """Arrow types of the answers, those of the run's columns taken from the batch."""
        kept = [(c, batch.schema.field(c).type) for c in names]
        return pa.schema([*kept, ("status", pa.string()), ("age", number), *((f"prev_{c}", batch.schema.field(c).type) for c in previous), *more])

    def answers(batch: pa.RecordBatch, status: np.ndarray, age: np.ndarray) -> tuple[pa.Array, pa.Array]:
        return words.take(pa.array(status)), pa.array(age, pa.int64(), mask=status == 0)

    def shifted(batch: pa.RecordBatch, before: pa.RecordBatch | None, same: np.ndarray) -> list[pa.Array]:
        """The ``previous`` columns of the row before, null where that is none of the key."""
        out = []
        for c in previous:
            column = batch.column(names.index(c))
            head = pa.nulls(1, column.type) if before is None else before.column(names.index(c))
            moved = pa.concat_arrays([head, column.slice(0, len(column) - 1)])
            out.append(pc.if_else(pa.array(same), moved, pa.scalar(None, column.type)))
        return out

    def fold_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        known: _Cache | None = None
        first: _Cache | None = None
        last: pa.RecordBatch | None = None
        leading: list[np.ndarray] = []

        def row_batch(rows: pa.RecordBatch, extra: dict, kind: np.ndarray) -> pa.RecordBatch:
            arrow = typed(rows, [("_k", number), ("_c", number), ("_t", number), ("part", pa.int32()), ("kind", pa.int32()), ("first_k", number), ("first_c", number),
                                 ("first_t", number), ("anchor", number), ("seconds", numbers), ("entries", numbers)])
            columns = dict(zip(rows.schema.names, rows.columns)) | extra | {"part": pa.array(np.full(len(kind), part, np.int32)), "kind": pa.array(kind)}
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(kind), f.type) for f in arrow], schema=arrow)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, contents, times = (batch.column(c).to_numpy() for c in ("_k", "_c", "_t"))
            before = last.column("_k")[0].as_py() if last is not None else None
            same = np.concatenate([[before == keys[0]], keys[1:] == keys[:-1]])
            extra = {f"prev_{c}": v for c, v in zip(previous, shifted(batch, last, same))}
            kind = np.full(n, _FINAL, np.int32)
            status, age = np.zeros(n, np.int8), np.zeros(n, np.int64)
            done = 0
            if known is None:
                # The first segment waits, and the run that ends it, if it is of the same key.
                if first is None:
                    first = _Cache(int(keys[0]), int(contents[0]), int(times[0]), 0)
                    found = _starts(keys, contents, times, ttl)
                    done = int(found[0]) if len(found) else n
                else:
                    end = last.column("_t")[0].as_py()
                    found = _starts(*(np.concatenate([[x], y]) for x, y in ((first.key, keys), (first.content, contents), (end, times))), ttl) - 1
                    done = int(found[0]) if len(found) else n
                kind[:done] = _PENDING
                leading.append(times[:done])
                if done < n:
                    if keys[done] == first.key:
                        kind[done] = _PENDING
                    known = _Cache(int(keys[done]), int(contents[done]), int(times[done]), int(times[done]))
                    done += 1
            if done < n:
                status[done:], age[done:], known = _fold(keys[done:], contents[done:], times[done:], ttl, known)
            extra |= dict(zip(("status", "age"), answers(batch, status, age)))
            yield row_batch(batch, extra, kind)
            last = batch.slice(n - 1)
        if last is not None:
            seconds, entries = _jumps(np.concatenate(leading), ttl) if known is None else (None, None)
            one = {"first_k": first.key, "first_c": first.content, "first_t": first.t, "anchor": known.anchor if known else None}
            extra = {c: pa.array([v], number) for c, v in one.items()} | {"seconds": pa.array([seconds], numbers), "entries": pa.array([entries], numbers)}
            yield row_batch(last, extra, np.array([_SUMMARY], np.int32))

    ranged = entered.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    path = shared_dir(runs.sparkSession, "session-ranges")
    ranged.mapInArrow(fold_ranges, first_pass).write.partitionBy("kind").parquet(path)
    stored = runs.sparkSession.read.schema(first_pass).parquet(path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in front of every range."""
        now: _Cache | None = None
        row: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                out = {"part": r["part"], "in_k": now and now.key, "in_c": now and now.content, "in_t": now and now.t, "in_anchor": now and now.anchor}
                out |= {f"in_{c}": row.get(c) for c in previous}
                given = [("part", pa.int32()), *((f"in_{c}", number) for c in ("k", "c", "t", "anchor")), *((f"in_{c}", batch.schema.field(c).type) for c in previous)]
                yield pa.RecordBatch.from_pylist([out], schema=pa.schema(given))
                anchor = r["anchor"]
                if anchor is None:
                    goes_on = now and (now.key, now.content) == (r["first_k"], r["first_c"]) and r["first_t"] - now.t < ttl
                    at = now.anchor if goes_on else r["first_t"]
                    i = bisect_left(r["seconds"], at + ttl)
                    anchor = r["entries"][i] if i < len(r["seconds"]) else at
                now, row = _Cache(r["_k"], r["_c"], r["_t"], anchor), r

    state_schema = ", ".join(["part int", *state])
    wanted = ["part", "_k", "_c", "_t", "first_k", "first_c", "first_t", "anchor", "seconds", "entries"]
    # One row a range, streamed through one task in order.
    carry = (stored.where(F.col("kind") == _SUMMARY).select(*dict.fromkeys([*wanted, *previous]))
             .repartition(1).sortWithinPartitions("part").mapInArrow(scan, state_schema))

    def fold_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, row = None, None, None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]]).tolist())):
                if hi == lo:
                    continue
                some = batch.slice(lo, hi - lo)
                fresh = parts[lo] != part
                if fresh:
                    part, row = parts[lo], some.slice(0, 1)
                    given = [row.column(c)[0].as_py() for c in ("in_k", "in_c", "in_t", "in_anchor")]
                    now = None if given[0] is None else _Cache(*given)
                keys = some.column("_k").to_numpy()
                status, age, now = _fold(keys, some.column("_c").to_numpy(), some.column("_t").to_numpy(), ttl, now)
                columns = {c: some.column(c) for c in [*names, *(f"prev_{c}" for c in previous)]}
                columns |= dict(zip(("status", "age"), answers(some, status, age)))
                if fresh and row.column("in_k")[0].as_py() == keys[0]:
                    for c in previous:
                        own = columns[f"prev_{c}"]
                        columns[f"prev_{c}"] = pa.concat_arrays([row.column(f"in_{c}").cast(own.type), own.slice(1)])
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in typed(some)], schema=typed(some))

    pending = stored.where(F.col("kind") == _PENDING).join(F.broadcast(carry), "part")  # a row for each range
    again = (pending.repartition("part").sortWithinPartitions("part", *key, *order).mapInArrow(fold_first, ", ".join(body)))
    columns = [*names, "status", "age", *(f"prev_{c}" for c in previous)]
    return stored.where(F.col("kind") == _FINAL).select(*columns).union(again.select(*columns))
