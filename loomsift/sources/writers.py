"""Sinks: kept full outputs (tee), savings ledger, compact texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import text as T


def _append(rows: DataFrame, path: str, format: str, run: str | None, by: tuple[str, ...] = ()) -> None:
    """Append rows; those of a named run replace what an earlier attempt of that run wrote.

    A run has the folder ``run=<name>``, which is overwritten as a whole, so a job that is
    repeated after any failure leaves each row once.  One path takes either named runs or none.
    """
    out = rows.write.format(format).partitionBy(*by) if by else rows.write.format(format)
    if run is None:
        out.mode("append").save(path)
    elif not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError(f"a run is named by letters, digits, dots, dashes and underscores: {run!r}")
    else:
        out.mode("overwrite").option("partitionOverwriteMode", "static").save(f"{path}/run={run}")


def tee_slug(argv: Column) -> Column:
    words = F.array_join(F.slice(argv, 1, 3), " ")
    return F.substring(F.regexp_replace(words, "[^a-zA-Z0-9]+", "_"), 1, 40)


def tee_policy(mode: str, code: str = "code", raw: str = "raw", compact: str = "compact") -> Column:
    """Rows whose full text is kept: failing and shortened, all, or none."""
    if mode == "always":
        return F.lit(True)
    if mode == "never":
        return F.lit(False)
    return (F.col(code) != 0) & (F.length(compact) < F.length(raw))


def tee_rows(results: DataFrame, mode: str = "failures") -> DataFrame:
    return results.where(tee_policy(mode)).select(
        "capture_id", F.to_date("ts").alias("dt"),
        F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("_"), tee_slug(F.col("argv")),
                 F.lit(".log")).alias("name"), "raw")


def write_tee(results: DataFrame, path: str, mode: str = "failures", run: str | None = None) -> None:
    """Kept full outputs by day; with a ``run`` a repeated job replaces its own rows."""
    _append(tee_rows(results, mode), path, "parquet", run, ("dt",))


def ledger_rows(results: DataFrame) -> DataFrame:
    return results.select(F.col("ts").alias("t"), F.col("label").alias("cmd"),
                          T.est_tokens(F.col("raw")).cast("bigint").alias("raw"),
                          T.est_tokens(F.col("compact")).cast("bigint").alias("out"))


def append_ledger(results: DataFrame, path: str, run: str | None = None) -> None:
    """Ledger rows as JSON lines; with a ``run`` a repeated job replaces its own rows."""
    rows = ledger_rows(results).withColumn("t", F.unix_seconds(F.col("t").cast("timestamp")))
    _append(rows, path, "json", run)


def write_compact(results: DataFrame, path: str, run: str | None = None) -> None:
    """Compact texts as parquet, final newline added where missing; with a ``run`` a repeated job replaces its own rows."""
    end = F.when(F.endswith("compact", F.lit("\n")), F.col("compact")) \
        .otherwise(F.concat("compact", F.lit("\n")))
    _append(results.withColumn("compact", end), path, "parquet", run)
