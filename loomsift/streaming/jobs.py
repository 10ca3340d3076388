"""The same jobs on streams of captures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomsift import patterns as P
from loomsift.plans.shapes import compact_log
from loomsift.sources.writers import tee_rows

CACHE_SCHEMA = "cmd_key string, capture_id bigint, t bigint, status string, age bigint, diff string"
#: The stored entry, and the runs that wait for the watermark.
CACHE_STATE = ("at bigint, hash string, text string, wait_t array<bigint>, wait_id array<bigint>, wait_hash array<string>, "
               "wait_text array<string>")


def stream_compact(captures: DataFrame, job: Callable[[Column], Column] = compact_log) -> DataFrame:
    """Compact every capture of a stream; a narrow map without state."""
    return captures.withColumn("compact", job(F.col("raw")))


def changed_lines(old: str | None, new: str | None, most: int = P.CACHE_DIFF_LINES) -> str | None:
    """The lines of ``snapshot_diff``: gone and added lines as a multiset; null without any or with more than ``most``."""
    if old is None or new is None:
        return None
    a, b = Counter(old.split("\n")), Counter(new.split("\n"))
    lines = ["-" + x for x in sorted((a - b).elements())] + ["+" + x for x in sorted((b - a).elements())]

    def clip(line: str) -> str:
        over = len(line) - 1 - P.MAX_LINE_CHARS
        return line if over <= 0 else f"{line[:P.MAX_LINE_CHARS + 1]} ...[+{over} chars]"

    return "\n".join(map(clip, lines)) if 0 < len(lines) <= most else None


def stream_session_cache(runs: DataFrame, ttl: int = P.CACHE_TTL_SECONDS, delay: str = "1 hour", text: str | None = None) -> DataFrame:
    """Session cache as keyed state: new, unchanged or changed per run, in the order of event time.

    Input columns ``cmd_key``, ``capture_id``, ``t`` (event time in seconds), ``hash`` and,
    when named, ``text``: then ``diff`` holds the changed lines of a *changed* run.

    A run waits in the state until the watermark, ``delay`` behind the latest run of the
    stream, has passed it; from then on no earlier run can come, and it is answered after
    all earlier ones (ties by capture_id).  So the answers are those of ``session_fold``
    however the stream is cut into batches.  Runs later than ``delay`` are not seen.  The
    state is the stored entry and the runs of the last ``delay``; batches of a key stream
    through.  An entry is dropped once the watermark is ``ttl`` past it.
    """
    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        at, content, body, *wait = state.get if state.exists else (None, None, None, [], [], [], [])
        waiting = list(zip(*wait))
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += zip(pdf["t"].tolist(), pdf["capture_id"].tolist(), pdf["hash"].tolist(), pdf["text"].tolist())
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: (r[0], r[1]))
        n = sum(r[0] * 1000 <= mark for r in waiting)
        out = []
        for t, capture, h, shown in waiting[:n]:
            fresh = at is not None and t - at < ttl
            if fresh and h == content:
                out.append((capture, t, "unchanged", t - at, None))
                continue
            out.append((capture, t, "changed" if fresh else "new", t - at if fresh else None, changed_lines(body, shown) if fresh else None))
            at, content, body = t, h, shown
        waiting = waiting[n:]
        if not waiting and at is not None and (at + ttl) * 1000 <= mark:
            state.remove()
        else:
            state.update((at, content, body, *(list(c) for c in zip(*waiting))) if waiting else (at, content, body, [], [], [], []))
            # Due as soon as the watermark reaches the first run that waits, or the end of the entry.
            state.setTimeoutTimestamp(max((waiting[0][0] if waiting else at + ttl) * 1000 - 1, mark))
        if out:
            capture, t, status, age, diff = zip(*out)
            yield pd.DataFrame({"cmd_key": key[0], "capture_id": capture, "t": t, "status": status, "age": pd.array(age, dtype="Int64"), "diff": diff})

    timed = (runs.select("cmd_key", "capture_id", F.col("t").cast("bigint").alias("t"), F.col("hash").cast("string").alias("hash"),
                         (F.col(text) if text else F.lit(None)).cast("string").alias("text"))
             .withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", delay))
    return timed.groupBy("cmd_key").applyInPandasWithState(step, CACHE_SCHEMA, CACHE_STATE, "append", "EventTimeTimeout")


def stream_ledger(ledger: DataFrame) -> DataFrame:
    """Running token sums per command (output mode ``complete`` or ``update``)."""
    g = ledger.groupBy("cmd").agg(F.count("*").alias("runs"), F.sum("raw").alias("raw"), F.sum("out").alias("out"))
    return g.withColumn("saved", F.col("raw") - F.col("out"))


def stream_tee(results: DataFrame, path: str, checkpoint: str, mode: str = "failures") -> DataStreamWriter:
    """Keep the full text of failing, shortened runs.

    The parquet sink commits every micro-batch once, also after a lost executor.
    """
    return (tee_rows(results, mode).writeStream.format("parquet").partitionBy("dt")
            .option("path", path).option("checkpointLocation", checkpoint))
