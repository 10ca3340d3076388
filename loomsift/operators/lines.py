"""Ordered operators on *line tables*: one row per line, keyed by a stream.

A stream may hold a large share of all rows, so none of these operators puts a
whole stream into one window partition.  Windows run inside (stream, chunk); what
crosses a chunk border travels in per-chunk summaries, which are smaller by the
chunk size.  A ``chunk`` is a column that is non-decreasing along the order of a
stream and cuts it into pieces that fit a task (a time bucket, ``n div 65536``).
Where the caller has none (``chunk=None``), ``range_chunks`` cuts pieces of at
most 65,536 lines, whatever the streams look like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions.text import split_lines, strip
from loomsift.session import shared_dir

CHUNK_LINES = 65536


def explode_lines(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Documents to lines numbered by ``at``, counted from 1."""
    return docs.select(*keep, F.posexplode(split_lines(F.col(text))).alias("at", "line")) \
        .withColumn("at", F.col("at") + 1)


def line_chunk(n: Column, size: int = CHUNK_LINES) -> Column:
    return F.floor(n / size)


def require_keys(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail on a null key: an equality join would silently lose its rows."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null in key column {c}")))
                             for c in columns})


def range_chunks(lines: DataFrame, stream: Sequence[str], order: Sequence[str],
                 name: str = "chunk", size: int = CHUNK_LINES) -> DataFrame:
    """The lines with a ``chunk`` of at most ``size`` lines that rises along every stream.

    Lines are dealt and sorted by (stream, order) ranges, so one stream with most of the
    lines is spread over all tasks; each range is then cut by row count.  Where equal
    orders end up is free, so the result is written to the shared folder once: all later
    branches, and tasks that are run again, see the same chunks.
    """
    ranged = require_keys(lines, stream).repartitionByRange(*stream, *order).sortWithinPartitions(*stream, *order)
    path = shared_dir(lines.sparkSession, "line-chunks")
    cut = ranged.withColumn(name, F.expr(f"monotonically_increasing_id() div {size}"))
    cut.write.parquet(path)
    return lines.sparkSession.read.schema(cut.schema).parquet(path)


def _chunked(lines: DataFrame, stream: Sequence[str], chunk: str | None, order: Sequence[str]) -> tuple[DataFrame, str]:
    """The lines and the name of their chunk column, cut here if the caller has none."""
    return (lines, chunk) if chunk else (range_chunks(lines, stream, order, "_cut"), "_cut")


def islands(lines: DataFrame, stream: Sequence[str], chunk: str | None, order: Sequence[str],
            line: str = "line", key: Column | None = None,
            merge_blank: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive equal lines (or equal ``key``) of every stream.

    Result: stream columns, the order columns of the first line, ``line`` (the
    first line), ``key``, ``n`` (lines in the run) and the ``keep`` columns of the
    first line.  Null lines equal each other, wherever the chunks are cut.

    Runs are found inside each chunk first.  Only the first and the last run of
    a chunk can continue in a neighbour, so only those share a second window
    partition per stream; all others stay with their chunk.
    """
    stream, order = list(stream), list(order)
    rows = lines.select(*stream, *([F.col(chunk).alias("_chunk")] if chunk else []), *order,
                        *[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(line).alias("line"),
                        (key if key is not None else F.col(line)).alias("key"))
    if not chunk:
        rows = range_chunks(rows, stream, order, "_chunk")
    inside = Window.partitionBy(*stream, "_chunk").orderBy(*order)
    new = ~F.col("key").eqNullSafe(F.lag("key").over(inside)) | F.lag(F.lit(1)).over(inside).isNull()
    if not merge_blank:
        new = new | (strip(F.col("key")) == "")
    # Every line of a run carries the same run number, so a run aggregates in
    # the partition its chunk already sits in.
    local = (rows.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(
                inside.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*stream, "_chunk", "_run")
             .agg(F.min(F.struct(*order, *[f"_keep_{c}" for c in keep], "line", "key")).alias("_first"), F.count("*").alias("_n")))
    all_of_chunk = Window.partitionBy(*stream, "_chunk")
    local = local.withColumn("_last", F.max("_run").over(all_of_chunk))
    border = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    local = local.withColumn("_seam", F.when(border, F.lit(None)).otherwise(F.struct("_chunk", "_run")))
    seam = Window.partitionBy(*stream, "_seam").orderBy("_chunk", "_run")
    joins = ((F.lag("_chunk").over(seam) != F.col("_chunk"))
             & F.lag("_first").over(seam)["key"].eqNullSafe(F.col("_first")["key"]))
    if not merge_blank:
        joins = joins & (strip(F.col("_first")["key"]) != "")
    merged = (local.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
              .withColumn("_id", F.sum("_new").over(seam.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*stream, "_seam", "_id")
              .agg(F.min("_first").alias("_first"), F.sum("_n").alias("n")))
    return merged.select(*stream, *[F.col("_first")[c].alias(c) for c in order],
                         *[F.col("_first")[f"_keep_{c}"].alias(c) for c in keep],
                         F.col("_first")["line"].alias("line"), F.col("_first")["key"].alias("key"), "n")


def count_mark(line: Column, n: Column, suffix: str = "") -> Column:
    return F.concat(line, A.times(n, suffix))


def dedup_consecutive(lines: DataFrame, stream: Sequence[str], chunk: str | None,
                      order: Sequence[str], line: str = "line",
                      strip_pattern: str | None = None) -> DataFrame:
    """Runs as ``line  (xN)``; ``strip_pattern`` is removed before comparing."""
    key = F.regexp_replace(F.col(line), strip_pattern, "") if strip_pattern else None
    runs = islands(lines, stream, chunk, order, line, key)
    return runs.select(*stream, *order, F.when(F.col("n") > 1, count_mark(F.col("line"), F.col("n")))
                       .otherwise(F.col("line")).alias("line"), "n")


def smart_dedup(lines: DataFrame, stream: Sequence[str], chunk: str | None, order: Sequence[str],
                key: Column, line: str = "line",
                min_total: int = P.SMART_DEDUP_MIN_TOTAL) -> DataFrame:
    """Runs of equal ``key``; keys that come back keep only their first line.

    A key with fewer than ``min_total`` lines has fewer than ``min_total`` runs
    and any other key that comes back keeps one, so at most ``min_total`` - 1
    runs per key are needed next to the totals.  The totals are partial sums and
    the first runs are cut per task before the exchange: a line that makes up a
    third of the table costs a few rows per task.
    """
    stream, order = list(stream), list(order)
    runs = islands(require_keys(lines, stream), stream, chunk, order, line,
                   F.coalesce(key, F.lit("")), merge_blank=False)
    blank = strip(F.col("key")) == ""
    words = runs.where(~blank)
    totals = words.groupBy(*stream, "key").agg(F.sum("n").alias("_total"), F.count("*").alias("_runs"))
    rank = Window.partitionBy(*stream, "key").orderBy(*order)
    early = words.withColumn("_rank", F.row_number().over(rank)) \
        .where(F.col("_rank") <= max(1, min_total - 1))
    again = (F.col("_runs") > 1) & (F.col("_total") >= min_total)
    kept = early.join(totals, [*stream, "key"]).where(~again | (F.col("_rank") == 1))
    # A key that does not come back but has many lines is one run (rank 1).
    out = kept.select(*stream, *order,
                      F.when(again, count_mark(F.col("line"), F.col("_total"), " total"))
                      .when(F.col("n") > 1, count_mark(F.col("line"), F.col("n")))
                      .otherwise(F.col("line")).alias("line"),
                      F.when(again, F.col("_total")).otherwise(F.col("n")).alias("n"))
    return out.unionByName(runs.where(blank).select(*stream, *order, "line", "n"))


def chunk_prefix(lines: DataFrame, stream: Sequence[str], chunk: str,
                 summary: dict[str, Column], prefix: dict[str, Column]) -> DataFrame:
    """Attach to every line what the earlier chunks of its stream say.

    ``summary`` aggregates one chunk (partial aggregation); ``prefix`` combines
    the summaries of all earlier chunks and must be an aggregate usable as a
    window function.  The join key (stream, chunk) is unique on one side.
    """
    stream = list(stream)
    lines = require_keys(lines, [*stream, chunk])
    per_chunk = lines.groupBy(*stream, chunk).agg(*[e.alias(c) for c, e in summary.items()])
    before = Window.partitionBy(*stream).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*stream, chunk, *[e.over(before).alias(c) for c, e in prefix.items()])
    return lines.join(carried, [*stream, chunk])


def number_lines(lines: DataFrame, stream: Sequence[str], chunk: str | None,
                 order: Sequence[str], name: str = "n") -> DataFrame:
    """1-based position of every line in its stream."""
    lines, chunk, given = *_chunked(lines, stream, chunk, order), chunk
    out = chunk_prefix(lines, stream, chunk, {"_count": F.count("*")}, {"_before": F.sum("_count")})
    inside = Window.partitionBy(*stream, chunk).orderBy(*order)
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(inside)) \
        .drop("_before", *([] if given else [chunk]))


def block_id(lines: DataFrame, stream: Sequence[str], chunk: str | None, order: Sequence[str],
             marker: Column, name: str = "block") -> DataFrame:
    """Number of marker lines up to and including each line."""
    lines, chunk, given = *_chunked(lines, stream, chunk, order), chunk
    marks = F.count_if(marker)
    out = chunk_prefix(lines, stream, chunk, {"_marks": marks}, {"_before": F.sum("_marks")})
    inside = Window.partitionBy(*stream, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + marks.over(inside)) \
        .drop("_before", *([] if given else [chunk]))


def carry_forward(lines: DataFrame, stream: Sequence[str], chunk: str | None, order: Sequence[str],
                  value: Column, name: str = "carried") -> DataFrame:
    """Last non-null ``value`` at or before each line (file, section, ...)."""
    lines, chunk, given = *_chunked(lines, stream, chunk, order), chunk
    rows = lines.withColumn("_value", value)
    at = F.struct(*order)
    out = chunk_prefix(
        rows, stream, chunk,
        {"_last": F.max_by("_value", F.when(F.col("_value").isNotNull(), at))},
        {"_before": F.last("_last", ignorenulls=True)})
    inside = Window.partitionBy(*stream, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_before")) \
        .drop("_value", "_before", *([] if given else [chunk]))


def context_rows(lines: DataFrame, stream: Sequence[str], chunk: str | None, order: Sequence[str],
                 hit: Column, context: int = 1) -> DataFrame:
    """Lines with a hit among their ``context`` neighbours on either side.

    Neighbours in the same chunk come from the chunk's window.  Only the
    ``context`` first and last lines of a chunk look further; they meet in one
    seam partition per stream, where true positions decide who is near.
    """
    stream, order = list(stream), list(order)
    lines, chunk, given = *_chunked(lines, stream, chunk, order), chunk
    rows = number_lines(lines.withColumn("_hit", F.when(hit, 1).otherwise(0)),
                        stream, chunk, order, "_pos")
    inside = Window.partitionBy(*stream, chunk)
    by_pos = inside.orderBy("_pos").rangeBetween(-context, context)
    rows = (rows.withColumn("_near", F.max("_hit").over(by_pos))
            .withColumn("_low", F.min("_pos").over(inside))
            .withColumn("_high", F.max("_pos").over(inside)))
    edge = ((F.col("_pos") - F.col("_low") < context) | (F.col("_high") - F.col("_pos") < context))
    # Hits from other chunks can only be edge lines themselves: small side.
    edges = rows.where(edge)
    seam = Window.partitionBy(*stream).orderBy("_pos").rangeBetween(-context, context)
    far = edges.withColumn("_near", F.greatest("_near", F.max("_hit").over(seam)))
    both = rows.where(~edge).unionByName(far)
    return both.where(F.col("_near") == 1).drop("_hit", "_near", "_low", "_high", "_pos", *([] if given else [chunk]))


def first_occurrence(lines: DataFrame, stream: Sequence[str], order: Sequence[str],
                     value: str = "line") -> DataFrame:
    """First row of every distinct value of a stream and how often it occurs."""
    first = lines.groupBy(*stream, value).agg(F.min(F.struct(*order)).alias("_at"),
                                              F.count("*").alias("n"))
    return first.select(*stream, value, *[F.col("_at")[c].alias(c) for c in order], "n")


def top_k_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                    k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; every task cuts to ``k`` before the exchange."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def head_tail(lines: DataFrame, stream: Sequence[str], order: Sequence[str],
              limit: int = P.MAX_LINES, line: str = "line") -> DataFrame:
    """Head and tail rows of every stream plus one marker row in between.

    Result: stream columns, ``slot`` (output position from 1) and ``line``.
    Counts are partial sums; head and tail are cut per task, so at most
    ``limit`` rows of a stream meet in the last step.
    """
    from loomsift.functions.text import clip_line

    stream, order = list(stream), list(order)
    head = limit * 2 // 3
    rows = require_keys(lines, stream).select(*stream, *order, F.col(line).alias("line"))
    top = top_k_per_group(rows, stream, order, head, "_rank").withColumn("_part", F.lit(1))
    end = top_k_per_group(rows, stream, [F.col(c).desc() for c in order], limit - head, "_rank") \
        .withColumn("_part", F.lit(2))
    sizes = rows.groupBy(*stream).agg(F.count("*").alias("_size"))
    both = (top.unionByName(end)
            .join(sizes, stream)
            .withColumn("slot", F.when(F.col("_part") == 1, F.col("_rank"))
                        .otherwise(F.least(F.col("_size"), F.lit(limit + 1)) - F.col("_rank") + 1)))
    # In a short stream the same line can be in both parts.
    once = both.where((F.col("_part") == 1) | (F.col("_size") > head)
                      & (F.col("_size") - F.col("_rank") >= head))
    marker = sizes.where(F.col("_size") > limit).select(
        *stream, F.lit(head + 1).cast("bigint").alias("slot"),
        F.concat(F.lit("... ["), (F.col("_size") - limit).cast("string"),
                 F.lit(" lines omitted] ...")).alias("line"))
    return once.select(*stream, F.col("slot").cast("bigint").alias("slot"),
                       clip_line(F.col("line")).alias("line")).unionByName(marker)
