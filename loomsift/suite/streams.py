"""Queries over line tables: events as log lines of a user's stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import text as T
from loomsift.operators import lines, profiles, versions
from loomsift.suite import base as B
from loomsift.suite.base import Derived, query, read

# One log line per event; a stream is a user, cut into days.
EVLOG = Derived("events", (
    "user_id", "event_id", "ts", "CAST(ts AS DATE) AS day", "value", "event_type",
    "CAST(ts AS STRING) || ' ' || upper(event_type) || ' event' AS line"))
KEY, CHUNK, ORDER = ["user_id"], "day", ["ts", "event_id"]
_REL = EVLOG.sql
_POS = f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {_REL})"
_TYPE = "regexp_replace(line, '^\\S+ \\S+ ', '')"


def log(spark, d):
    return EVLOG.df(spark, d)


@query("islands", f"""
SELECT user_id, e.event_id, k AS key, CAST(c AS BIGINT) AS n FROM {B.islands(_REL, 'user_id', 'ts, event_id', 'event_type')}
JOIN {_POS} e USING (user_id) WHERE e.n = pos""")
def islands(spark, d):
    runs = lines.islands(log(spark, d), KEY, CHUNK, ORDER, "line", F.col("event_type"))
    return runs.select("user_id", "event_id", "key", "n")


@query("dedup_by_message", f"""
SELECT user_id, CASE WHEN c > 1 THEN line || '  (x' || c || ')' ELSE line END AS line, CAST(c AS BIGINT) AS n
FROM {B.islands(_REL, 'user_id', 'ts, event_id', _TYPE)}""")
def dedup_by_message(spark, d):
    out = lines.dedup_consecutive(log(spark, d), KEY, CHUNK, ORDER, strip_pattern=r"^\S+ \S+ ")
    return out.select("user_id", "line", "n")


@query("smart_dedup_stream", f"""
SELECT user_id, line, CAST(cnt AS BIGINT) AS n FROM {B.smart_lines(_REL, 'user_id', 'ts, event_id')}""")
def smart_dedup_stream(spark, d):
    out = lines.smart_dedup(log(spark, d), KEY, CHUNK, ORDER, T.line_template(F.col("line")))
    return out.select("user_id", "line", "n")


@query("context_rows", f"""
SELECT user_id, event_id, line FROM {B.error_context(_REL, 'user_id', 1, 'ts, event_id')}""")
def context_rows(spark, d):
    return lines.context_rows(log(spark, d), KEY, CHUNK, ORDER, T.is_error(F.col("line")), 1) \
        .select("user_id", "event_id", "line")


@query("context_rows_3", f"""
SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' AND value > 60 THEN 1 ELSE 0 END) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {_REL}) WHERE near = 1""")
def context_rows_3(spark, d):
    hit = (F.col("event_type") == "purchase") & (F.col("value") > 60)
    return lines.context_rows(log(spark, d), KEY, CHUNK, ORDER, hit, 3).select("user_id", "event_id")


@query("number_lines", f"SELECT user_id, event_id, n FROM {_POS}")
def number_lines(spark, d):
    return lines.number_lines(log(spark, d), KEY, CHUNK, ORDER).select("user_id", "event_id", "n")


@query("carry_forward_file", f"""
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN 'file_' || event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file FROM {_REL}""")
def carry_forward_file(spark, d):
    mark = F.when(F.col("event_type") == "signup", F.concat(F.lit("file_"), F.col("event_id").cast("string")))
    return lines.carry_forward(log(spark, d), KEY, CHUNK, ORDER, mark, "file").select("user_id", "event_id", "file")


@query("carry_forward_section", f"""
SELECT user_id, section, count(*) AS lines FROM (
  SELECT user_id, last_value(CASE WHEN value > 90 THEN event_type END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM {_REL}) GROUP BY user_id, section""")
def carry_forward_section(spark, d):
    mark = F.when(F.col("value") > 90, F.col("event_type"))
    rows = lines.carry_forward(log(spark, d), KEY, CHUNK, ORDER, mark, "section")
    return rows.groupBy("user_id", "section").agg(F.count("*").alias("lines"))


@query("block_id", f"""
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block
FROM {_REL}""")
def block_id(spark, d):
    return lines.block_id(log(spark, d), KEY, CHUNK, ORDER, F.col("event_type") == "error") \
        .select("user_id", "event_id", "block")


@query("head_tail_stream", f"""
SELECT user_id, CAST(CASE WHEN c <= 20 OR r <= 13 THEN r ELSE 21 - (c - r) END AS BIGINT) AS slot, line FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r,
    count(*) OVER (PARTITION BY user_id) AS c FROM {_REL}) WHERE c <= 20 OR r <= 13 OR r > c - 7
UNION ALL SELECT user_id, 14, '... [' || (count(*) - 20) || ' lines omitted] ...' FROM {_REL}
  GROUP BY user_id HAVING count(*) > 20""")
def head_tail_stream(spark, d):
    return lines.head_tail(log(spark, d), KEY, ORDER, 20)


@query("top_k_per_group", f"""
SELECT user_id, event_type, event_id, CAST(r AS BIGINT) AS rank, greatest(total - 5, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r,
    count(*) OVER (PARTITION BY user_id, event_type) AS total FROM {_REL}) WHERE r <= 5""")
def top_k_per_group(spark, d):
    rows = log(spark, d)
    top = lines.top_k_per_group(rows, ["user_id", "event_type"], ORDER, 5)
    total = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("total"))
    return top.join(total, ["user_id", "event_type"]).select(
        "user_id", "event_type", "event_id", F.col("rank").cast("bigint").alias("rank"),
        F.greatest(F.col("total") - 5, F.lit(0)).alias("more"))


@query("ordered_distinct", f"""
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM {_REL} GROUP BY ALL""")
def ordered_distinct(spark, d):
    return lines.first_occurrence(log(spark, d), KEY, ORDER, "event_type") \
        .select("user_id", "event_type", "event_id", "n")


@query("first_last_value", f"""
SELECT user_id, event_type, count(*) AS epochs, arg_min(value, n) AS first, arg_max(value, n) AS last
FROM {_POS} GROUP BY user_id, event_type""")
def first_last_value(spark, d):
    rows = lines.number_lines(log(spark, d), KEY, CHUNK, ORDER)
    return profiles.series_summary(rows, ["user_id", "event_type"], "n").select(
        "user_id", "event_type", "epochs", "first", "last")


@query("best_and_plateau", f"""
SELECT user_id, epochs, best, CAST(best_epoch AS BIGINT) AS best_epoch, epochs - best_epoch AS since_best,
       epochs - best_epoch >= greatest(5, epochs // 10) AS plateau FROM (
  SELECT user_id, count(*) AS epochs, min(value) AS best, arg_min(n, (value, n)) AS best_epoch FROM {_POS} GROUP BY user_id)""")
def best_and_plateau(spark, d):
    rows = lines.number_lines(log(spark, d), KEY, CHUNK, ORDER)
    return profiles.series_summary(rows, KEY, "n").select(
        "user_id", "epochs", "best", "best_epoch", "since_best", "plateau")


# --- one stream holds every line, and nothing says where to cut it -----------

HOST = Derived("events", ("'all' AS host", *EVLOG.exprs))
_HOST = HOST.sql
_WHOLE = "PARTITION BY host ORDER BY ts, event_id"


@query("number_lines_one_stream", f"SELECT host, event_id, row_number() OVER ({_WHOLE}) AS n FROM {_HOST}")
def number_lines_one_stream(spark, d):
    return lines.number_lines(HOST.df(spark, d), ["host"], None, ORDER).select("host", "event_id", "n")


@query("block_id_one_stream", f"""
SELECT host, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
  {_WHOLE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM {_HOST}""")
def block_id_one_stream(spark, d):
    return lines.block_id(HOST.df(spark, d), ["host"], None, ORDER, F.col("event_type") == "error") \
        .select("host", "event_id", "block")


@query("carry_forward_one_stream", f"""
SELECT host, event_id, last_value(CASE WHEN event_type = 'signup' THEN 'file_' || event_id END IGNORE NULLS) OVER (
  {_WHOLE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file FROM {_HOST}""")
def carry_forward_one_stream(spark, d):
    mark = F.when(F.col("event_type") == "signup", F.concat(F.lit("file_"), F.col("event_id").cast("string")))
    return lines.carry_forward(HOST.df(spark, d), ["host"], None, ORDER, mark, "file").select("host", "event_id", "file")


@query("context_rows_one_stream", f"""
SELECT host, event_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' AND value > 60 THEN 1 ELSE 0 END) OVER (
  {_WHOLE} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {_HOST}) WHERE near = 1""")
def context_rows_one_stream(spark, d):
    hit = (F.col("event_type") == "purchase") & (F.col("value") > 60)
    return lines.context_rows(HOST.df(spark, d), ["host"], None, ORDER, hit, 3).select("host", "event_id")


@query("islands_one_stream", f"""
SELECT host, e.event_id, k AS key, CAST(c AS BIGINT) AS n FROM {B.islands(_HOST, 'host', 'ts, event_id', 'event_type')}
JOIN (SELECT *, row_number() OVER ({_WHOLE}) AS n FROM {_HOST}) e USING (host) WHERE e.n = pos""")
def islands_one_stream(spark, d):
    return lines.islands(HOST.df(spark, d), ["host"], None, ORDER, "line", F.col("event_type")) \
        .select("host", "event_id", "key", "n")


# --- versions and the session cache ------------------------------------------

@query("content_version", f"""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS version,
       e.event_id AS first_event, CAST(c AS BIGINT) AS n, sha1(k) AS hash
FROM {B.islands(_REL, 'user_id', 'ts, event_id', 'event_type')} JOIN {_POS} e USING (user_id) WHERE e.n = pos""")
def content_version(spark, d):
    out = versions.content_version(log(spark, d), KEY, CHUNK, ORDER, "event_type")
    return out.select("user_id", "version", F.col("event_id").alias("first_event"), "n", "hash")


RUNS = Derived("events", ("user_id", "event_id", "event_type AS hash", "CAST(ts AS DATE) AS day",
                          "CAST(date_part('day', ts) AS BIGINT) * 86400 + CAST(date_part('hour', ts) AS BIGINT) * 3600 "
                          "+ CAST(date_part('minute', ts) AS BIGINT) * 60 AS t"))


def fold_sql(ttl: int) -> str:
    """The cache replayed run after run."""
    return f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM {RUNS.sql}),
f AS (
  SELECT user_id, event_id, n, t AS at, hash AS h, 'new' AS status, CAST(NULL AS BIGINT) AS age FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.event_id, r.n,
    CASE WHEN r.t - f.at < {ttl} AND r.hash = f.h THEN f.at ELSE r.t END,
    CASE WHEN r.t - f.at < {ttl} AND r.hash = f.h THEN f.h ELSE r.hash END,
    CASE WHEN r.t - f.at >= {ttl} THEN 'new' WHEN r.hash = f.h THEN 'unchanged' ELSE 'changed' END,
    CASE WHEN r.t - f.at < {ttl} THEN r.t - f.at END
  FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, event_id, status, age FROM f"""


@query("session_fold", fold_sql(P.CACHE_TTL_SECONDS))
def session_fold(spark, d):
    return versions.session_fold(RUNS.df(spark, d), KEY, ["t", "event_id"]) \
        .select("user_id", "event_id", "status", "age")


@query("cache_lookup", fold_sql(86400))
def cache_lookup(spark, d):
    return versions.session_fold(RUNS.df(spark, d), KEY, ["t", "event_id"], ttl=86400) \
        .select("user_id", "event_id", "status", "age")
