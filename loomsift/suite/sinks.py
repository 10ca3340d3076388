"""Queries over whole captures: rules, cache, tee, ledger, files, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsift.functions import text as T
from loomsift.plans import captures, shapes
from loomsift.session import shared_dir
from loomsift.sources import readers, writers
from loomsift.streaming import jobs
from loomsift.suite import base as B
from loomsift.suite.base import Derived, query, read
from loomsift.suite.documents import DOC_LINES, _log_sql
from loomsift.suite.runs import RUNS
from loomsift.suite.streams import RUNS as CACHE_RUNS
from loomsift.suite.streams import fold_sql

# Every document is the output of one command; the command picks the rule.
_CMD = ("CASE doc_id % 8 WHEN 0 THEN 'log app.log' WHEN 1 THEN 'journalctl -u x' WHEN 2 THEN 'summary run' WHEN 3 THEN 'docker logs web' "
        "WHEN 4 THEN 'err make' WHEN 5 THEN 'proxy ls' WHEN 6 THEN 'trim -' ELSE 'vim notes' END")
CAPTURES = Derived("documents", (
    "doc_id AS capture_id", f"{_CMD} AS cmd", "CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS code",
    "text AS raw", "CAST('2024-03-01 10:00:00' AS TIMESTAMP) AS ts"))


def all_captures(spark, d):
    return CAPTURES.df(spark, d).withColumn("argv", F.split("cmd", " "))


_TRIM = _log_sql(B.lines_of(f"(SELECT doc_id, trim(text, {B.WS}) AS text FROM documents)", "doc_id", "text"), "doc_id", 60)
_ERR = B.joined(B.error_context(DOC_LINES, "doc_id", 1), "doc_id", name="e")
_CAPTURED = f"""(
WITH b AS (
  SELECT d.doc_id, text, {_CMD} AS cmd, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS code, CASE d.doc_id % 8
    WHEN 0 THEN l.compact
    WHEN 1 THEN CASE WHEN d.doc_id % 3 = 0 THEN coalesce(e, j.compact) ELSE j.compact END
    WHEN 2 THEN g.compact
    WHEN 3 THEN CASE WHEN d.doc_id % 3 = 0 THEN coalesce(e, k.compact) ELSE k.compact END
    WHEN 4 THEN coalesce(e, '(no error lines detected)')
    WHEN 6 THEN {B.redact('t.compact')} ELSE text END AS c,
    d.doc_id % 8 = 6 AND {B.redact('t.compact')} <> t.compact AS redacted
  FROM documents d LEFT JOIN {_log_sql(DOC_LINES, 'doc_id', 50)} l USING (doc_id)
  LEFT JOIN {B.head_tail(B.smart_lines(DOC_LINES, 'doc_id'), 'doc_id', 50)} j USING (doc_id)
  LEFT JOIN {B.head_tail(B.dedup_lines(B.drop_progress(DOC_LINES), 'doc_id'), 'doc_id', 60)} g USING (doc_id)
  LEFT JOIN {_log_sql(DOC_LINES, 'doc_id', 45)} k USING (doc_id)
  LEFT JOIN {_TRIM} t USING (doc_id) LEFT JOIN {_ERR} USING (doc_id)),
f AS (SELECT *, CASE WHEN NOT redacted AND length(c) > length(text) THEN text ELSE c END AS floored FROM b)
SELECT doc_id, cmd, code, text, redacted, code <> 0 AND length(floored) < length(text) AS tee, floored ||
  CASE WHEN code <> 0 AND length(floored) < length(text) THEN chr(10) || '[full output: ' || regexp_replace(cmd, '[^a-zA-Z0-9]+', '_', 'g')
    || '.log]' ELSE '' END AS compact FROM f)"""


@query("compact_captures", f"SELECT doc_id AS capture_id, compact, redacted, tee FROM {_CAPTURED}")
def compact_captures(spark, d):
    # The strict bearer rule has no SQL twin; no given text holds a bearer value.
    return captures.compact_captures(all_captures(spark, d)).select("capture_id", "compact", "redacted", "tee")


@query("captures_gain", f"""
SELECT cmd, count(*) AS runs, CAST(sum(r) AS BIGINT) AS raw, CAST(sum(o) AS BIGINT) AS out, CAST(sum(r) - sum(o) AS BIGINT) AS saved,
  round((sum(r) - sum(o)) * 100.0 / sum(r), 4) AS pct FROM (
  SELECT CASE WHEN cmd LIKE 'docker%' THEN 'docker logs' WHEN cmd LIKE 'err %' THEN 'err make' WHEN cmd LIKE 'proxy %' THEN 'proxy ls' ELSE string_split(cmd, ' ')[1] END AS cmd,
    {B.tokens('text')} AS r, {B.tokens('compact')} AS o FROM {_CAPTURED}) GROUP BY ROLLUP (cmd)""")
def captures_gain(spark, d):
    done = captures.compact_captures(all_captures(spark, d))
    return captures.savings_report(writers.ledger_rows(done).drop("t")).withColumn("pct", F.round("pct", 4))


@query("measure_only", f"""
SELECT 'proxy ls' AS label, count(*) AS runs, CAST(sum({B.tokens('text')}) AS BIGINT) AS raw,
  CAST(sum({B.tokens('text')}) AS BIGINT) AS out FROM documents WHERE doc_id % 8 = 5""")
def measure_only(spark, d):
    proxied = all_captures(spark, d).where("cmd = 'proxy ls'")
    done = captures.compact_captures(proxied, tee_mode="never")
    return writers.ledger_rows(done).groupBy(F.col("cmd").alias("label")).agg(
        F.count("*").alias("runs"), F.sum("raw").alias("raw"), F.sum("out").alias("out"))


# Documents as outputs of one command, with their compact text.
_DONE = f"(SELECT d.doc_id, lang, text, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS code, c.compact FROM documents d JOIN {_log_sql(DOC_LINES, 'doc_id', 50)} c USING (doc_id))"


def _results(spark, d):
    r = all_captures(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("capture_id"), "lang"), "capture_id")
    return r.select("capture_id", F.array(F.lit("make"), F.col("lang"), F.lit("a/b")).alias("argv"), "code", "raw", "ts",
                    F.col("lang").alias("label"), shapes.compact_log(F.col("raw")).alias("compact"))


@query("write_tee", f"""
SELECT doc_id AS capture_id, '2024-03-01' AS dt, '1709287200_make_' || lang || '_a_b.log' AS name, CAST(length(text) AS INT) AS chars
FROM {_DONE} WHERE code <> 0 AND length(text) > length(compact)""")
def write_tee(spark, d):
    path = shared_dir(spark, "tee")
    writers.write_tee(_results(spark, d), path)
    back = spark.read.parquet(path)
    return back.select("capture_id", F.col("dt").cast("string").alias("dt"), "name", F.length("raw").alias("chars"))


@query("append_ledger", f"""
SELECT lang AS cmd, count(*) AS runs, CAST(sum({B.tokens('text')}) AS BIGINT) AS raw, CAST(sum({B.tokens('compact')}) AS BIGINT) AS out
FROM {_DONE} GROUP BY lang""")
def append_ledger(spark, d):
    path = shared_dir(spark, "ledger")
    writers.append_ledger(_results(spark, d), path)
    return readers.read_ledger(spark, path).groupBy("cmd").agg(
        F.count("*").alias("runs"), F.sum("raw").alias("raw"), F.sum("out").alias("out"))


@query("write_compact", f"""
SELECT doc_id AS capture_id, CAST(length(compact) + CASE WHEN ends_with(compact, chr(10)) THEN 0 ELSE 1 END AS INT) AS chars FROM {_DONE}""")
def write_compact(spark, d):
    path = shared_dir(spark, "compact")
    writers.write_compact(_results(spark, d).select("capture_id", "compact"), path)
    return spark.read.parquet(path).select("capture_id", F.length("compact").alias("chars"))


def _written_files(spark, d, name: str) -> str:
    """The documents as text files below ``lang=x/source=y`` folders."""
    path = shared_dir(spark, name)
    read(spark, d, "documents").select("lang", "source", F.col("text").alias("value")) \
        .write.partitionBy("lang", "source").text(path)
    return path


_FOLDER = "lang=([^/]+)/source=([^/]+)/"


@query("read_documents", """
SELECT lang, source, CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines
FROM documents GROUP BY lang, source""")
def read_documents(spark, d):
    files = readers.read_documents(spark, _written_files(spark, d, "files"), "*.txt").where(F.col("error").isNull())
    return files.groupBy(F.regexp_extract("path", _FOLDER, 1).alias("lang"), F.regexp_extract("path", _FOLDER, 2).alias("source")) \
        .agg(F.sum(F.length("text")).cast("bigint").alias("chars"),
             F.sum(F.size(T.split_lines(F.col("text"))) - 1).alias("lines"))


@query("scan_files", """
SELECT lang, source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang, source""")
def scan_files(spark, d):
    inv = readers.scan_files(spark, _written_files(spark, d, "scan"), "*.txt", limit=None)
    return inv.groupBy(F.regexp_extract("path", _FOLDER, 1).alias("lang"), F.regexp_extract("path", _FOLDER, 2).alias("source")) \
        .agg(F.sum("length").alias("bytes"))


@query("read_captures", f"""
SELECT capture_id, CAST(code AS INT) AS code, CAST(length(regexp_replace(t, '\\x1b\\[[0-9;?]*[ -/]*[@-~]', '', 'g')) AS INT) AS chars
FROM (SELECT *, chr(27) || '[1m' || raw || chr(27) || '[0m' AS t FROM {RUNS.sql})""")
def read_captures(spark, d):
    path = shared_dir(spark, "captures")
    raw = F.concat(F.lit("\x1b[1m"), "raw", F.lit("\x1b[0m"))
    RUNS.df(spark, d).select("capture_id", F.array(F.lit("make"), F.col("kind")).alias("argv"), "code", raw.alias("raw"),
                             F.lit("2024-03-01 10:00:00").cast("timestamp").alias("ts")).write.json(path)
    return readers.read_captures(spark, path, "json").select("capture_id", "code", F.length("raw").alias("chars"))


# --- session cache over captures ---------------------------------------------

@query("session_cache_captures", f"""
WITH s AS (SELECT event_id, status, age FROM ({fold_sql(1800)}))
SELECT event_id AS capture_id, CASE WHEN status = 'unchanged' THEN '(unchanged since ' || age || 's ago)' ELSE raw END AS compact,
  status = 'unchanged' AS redacted
FROM s JOIN (SELECT event_id, event_type || ' ' || repeat('x', 30) AS raw FROM events) USING (event_id)""")
def session_cache_captures(spark, d):
    # A change replaces the only line: its note is longer than the text itself.
    runs = CACHE_RUNS.df(spark, d)
    cap = runs.select(F.col("event_id").alias("capture_id"), F.array(F.lit("proxy"), F.col("user_id").cast("string")).alias("argv"),
                      F.lit(0).alias("code"), F.concat("hash", F.lit(" "), F.lit("x" * 30)).alias("raw"),
                      F.timestamp_seconds("t").alias("ts"))
    done = captures.compact_captures(cap, session_cache=True)
    return done.select("capture_id", "compact", "redacted")


# --- streams -----------------------------------------------------------------

def _stream(spark, d, table: str):
    """A given table as a stream, be it one file or a folder of files."""
    schema = read(spark, d, table).schema
    # A plain path must be a folder; a glob, here of this one name, may meet either.
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parque[t]")


def _run(df, spark, name: str, mode: str = "append"):
    """Drain a stream into a written table and read it back."""
    out, checkpoint = shared_dir(spark, name), shared_dir(spark, f"{name}-checkpoint")
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        # Each micro-batch holds the full result so far; the last one stays.
        q = writer.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("stream_ledger", """
SELECT event_type AS cmd, count(*) AS runs, CAST(sum(user_id * 10) AS BIGINT) AS raw, CAST(sum(user_id) AS BIGINT) AS out,
  CAST(sum(user_id * 9) AS BIGINT) AS saved FROM events GROUP BY event_type""")
def stream_ledger(spark, d):
    ledger = _stream(spark, d, "events").selectExpr("event_type AS cmd", "user_id * 10 AS raw", "user_id AS out")
    return _run(jobs.stream_ledger(ledger), spark, "stream-ledger", "complete")


@query("stream_compact", f"SELECT * FROM {_log_sql(DOC_LINES, 'doc_id', 50)}")
def stream_compact(spark, d):
    docs = _stream(spark, d, "documents").select("doc_id", F.col("text").alias("raw"))
    return _run(jobs.stream_compact(docs).select("doc_id", "compact"), spark, "stream-compact")


@query("stream_session_cache", fold_sql(1800))
def stream_session_cache(spark, d):
    ev = _stream(spark, d, "events").selectExpr(
        "CAST(user_id AS STRING) AS cmd_key", "event_id AS capture_id", f"{CACHE_RUNS.exprs[-1]}", "event_type AS hash")
    # The table comes in one batch: without a delay the watermark passes its last run.
    out = _run(jobs.stream_session_cache(ev, delay="0 seconds"), spark, "stream-cache")
    return out.select(F.col("cmd_key").cast("bigint").alias("user_id"), F.col("capture_id").alias("event_id"), "status", "age")


@query("stream_tee", """
SELECT event_id AS capture_id, '1704067200_make_' || event_type || '.log' AS name FROM events WHERE event_type = 'error'""")
def stream_tee(spark, d):
    ev = _stream(spark, d, "events").select(
        F.col("event_id").alias("capture_id"), F.array(F.lit("make"), F.col("event_type")).alias("argv"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("code"), F.repeat("props", 3).alias("raw"),
        F.col("props").alias("compact"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    out, checkpoint = shared_dir(spark, "stream-tee"), shared_dir(spark, "stream-tee-checkpoint")
    jobs.stream_tee(ev, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("capture_id", "name")
