"""Sources: captured outputs, whole files, path inventories, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import text as T

CAPTURE_SCHEMA = "capture_id bigint, argv array<string>, code int, raw string, ts timestamp"
LEDGER_SCHEMA = "t timestamp, cmd string, raw bigint, out bigint"


def read_captures(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Captured outputs; invalid bytes are repaired and escape codes removed at the door."""
    reader = spark.read.schema(CAPTURE_SCHEMA) if format == "json" else spark.read
    return clean_captures(reader.format(format).load(path))


def clean_captures(captures: DataFrame) -> DataFrame:
    """Undecodable bytes become the replacement character; ``raw`` may be binary or text."""
    text = F.make_valid_utf8(F.col("raw").cast("string"))
    return captures.withColumn("raw", T.strip_ansi(F.coalesce(text, F.lit(""))))


#: Largest file that becomes one row; ``read_lines`` reads files of any size in splits.
WHOLE_FILE_BYTES = 256 << 20


def read_documents(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """One row per file that is not empty: ``path``, ``text`` and ``error``.

    Undecodable bytes become the replacement character.  No bad file fails the job or
    vanishes: the listing has every file (but empty ones, which Spark scans skip), and one without content has a null ``text`` and
    an ``error``, ``too large`` beyond ``max_bytes`` (its content is not read, see
    ``read_lines``), else ``unreadable``.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
             .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path))
    listed = files.select("path", "length")
    # The bound on the length reaches the scan, which then does not open larger files.
    texts = files.where(F.col("length") <= max_bytes).select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return listed.join(texts, "path", "left").select(
        "path", "text", F.when(F.col("text").isNull(), F.when(F.col("length") > max_bytes, "too large").otherwise("unreadable")).alias("error"))


def scan_files(spark: SparkSession, path: str, glob: str = "*", limit: int | None = None,
               skip: tuple[str, ...] = P.SKIP_DIRS) -> DataFrame:
    """Inventory below a folder in path order; noise directories are pruned.

    Only metadata columns are asked for, so no file content is read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime"))
    kept = files.where(~T.any_segment(F.col("path"), skip)).orderBy("path")
    return kept.limit(limit) if limit else kept


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines savings ledger; malformed lines are dropped, later ones kept.

    ``t`` is in epoch seconds in the file.
    """
    rows = (spark.read.schema("t bigint, cmd string, raw bigint, out bigint")
            .option("mode", "DROPMALFORMED").json(path))
    return rows.select(F.timestamp_seconds("t").alias("t"), F.coalesce("cmd", F.lit("?")).alias("cmd"),
                       F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("out", F.lit(0)).alias("out"))


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of any size as a line table: ``stream`` (the file), ``chunk``, ``at`` and ``line``.

    A file is read in splits; ``chunk`` is the byte offset of a line's split and ``at``
    its number within it, so both order the lines of a stream and no file has to fit in
    a row.  Files must be splittable text; a line belongs to the split it starts in.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
             .select(F.col("_metadata.file_path").alias("stream"), F.col("_metadata.file_block_start").alias("chunk"),
                     F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")))
    # Ids rise along a split, and a split lies in one task.
    return lines.withColumn("at", F.row_number().over(Window.partitionBy("stream", "chunk").orderBy("_id")).cast("long")).drop("_id")
