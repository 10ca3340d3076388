"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T
from loomsift.operators import corpus, findings, lines, versions
from loomsift.plans import captures, shapes
from loomsift.suite import base as B
from loomsift.suite.base import Derived, query, read

DOC_LINES = B.lines_of("documents", "doc_id", "text")


def docs(spark, d):
    return read(spark, d, "documents", wide=True)


@query("explode_lines", f"SELECT doc_id, CAST(n AS BIGINT) AS n, line FROM {DOC_LINES}")
def explode_lines(spark, d):
    return lines.explode_lines(docs(spark, d), keep=["doc_id"]).select("doc_id", F.col("at").cast("bigint").alias("n"), "line")


@query("token_meter", f"""
SELECT source, count(*) AS docs, CAST(sum({B.tokens('text')}) AS BIGINT) AS tokens,
       round(avg({B.tokens('text')}), 4) AS avg_tokens, CAST(max({B.tokens('text')}) AS INT) AS max_tokens,
       CAST(quantile_disc({B.tokens('text')}, 0.95) AS INT) AS p95_tokens FROM documents GROUP BY source""")
def token_meter(spark, d):
    return corpus.token_meter(docs(spark, d), ["source"]).withColumn("avg_tokens", F.round("avg_tokens", 4))


@query("redact_corpus", f"""
SELECT doc_id, {B.redact('text')} AS masked, {B.redact('text')} <> text AS redacted FROM documents""")
def redact_corpus(spark, d):
    return corpus.redact_corpus(docs(spark, d), strict=False).select("doc_id", "masked", "redacted")


@query("redaction_facts", f"""
SELECT lang, CAST(sum(a) AS BIGINT) AS assignments, CAST(sum(t) AS BIGINT) AS token_shapes,
       count(*) FILTER (a + t > 0) AS docs
FROM (SELECT lang, len(regexp_extract_all(text, {B.lit(P.SECRET_ASSIGN)})) AS a,
             len(regexp_extract_all(text, {B.lit(P.SECRET_TOKEN)})) AS t FROM documents)
GROUP BY lang HAVING sum(a + t) > 0""")
def redaction_facts(spark, d):
    facts = corpus.redaction_facts(docs(spark, d), ["lang"])
    return facts.where(F.col("docs") > 0)


@query("clip_lines", f"""
SELECT doc_id, string_agg({B.clip('line')}, chr(10) ORDER BY n) AS clipped,
       CAST(count(*) FILTER (length(line) > 500) AS INT) AS clipped_lines FROM {DOC_LINES} GROUP BY doc_id""")
def clip_lines(spark, d):
    return corpus.clip_text(docs(spark, d)).select("doc_id", "clipped", "clipped_lines")


@query("line_template", f"""
SELECT template, count(*) AS n FROM (SELECT {B.template('line')} AS template FROM {DOC_LINES})
WHERE trim(template, {B.WS}) <> '' GROUP BY template ORDER BY n DESC, template LIMIT 50""")
def line_template(spark, d):
    return corpus.top_templates(docs(spark, d), 50)


@query("dedup_consecutive", f"SELECT * FROM {B.joined(B.dedup_lines(DOC_LINES, 'doc_id'), 'doc_id')}")
def dedup_consecutive(spark, d):
    return corpus.map_lines(docs(spark, d), A.dedup_consecutive).select("doc_id", "compact")


@query("smart_dedup", f"SELECT * FROM {B.joined(B.smart_lines(DOC_LINES, 'doc_id'), 'doc_id')}")
def smart_dedup(spark, d):
    return corpus.map_lines(docs(spark, d), A.smart_dedup).select("doc_id", "compact")


@query("first_occurrence", f"""
SELECT doc_id, line, CAST(min(n) AS BIGINT) AS first_n, count(*) AS n FROM {DOC_LINES} GROUP BY doc_id, line""")
def first_occurrence(spark, d):
    rows = lines.explode_lines(docs(spark, d), keep=["doc_id"]).withColumnRenamed("at", "first_n")
    out = lines.first_occurrence(rows, ["doc_id"], ["first_n"])
    return out.withColumn("first_n", F.col("first_n").cast("bigint"))


@query("head_tail", f"SELECT * FROM {B.head_tail(DOC_LINES, 'doc_id', 60)}")
def head_tail(spark, d):
    return corpus.map_lines(docs(spark, d), A.head_tail).select("doc_id", "compact")


def _budget_sql(limit: int) -> str:
    note = f"[output capped at ~{limit} tokens]"
    cuts = ", ".join(f"b{k}.compact || chr(10) || '{note}' AS c{k}" for k in P.BUDGET_LADDER)
    joins = " ".join(f"JOIN {B.head_tail(DOC_LINES, 'doc_id', k)} b{k} USING (doc_id)" for k in P.BUDGET_LADDER)
    cases = " ".join(f"WHEN {B.tokens(f'c{k}')} <= {limit} THEN c{k}" for k in P.BUDGET_LADDER)
    keep = limit * 4 - len(note) - 8
    return (f"SELECT doc_id, CASE WHEN {B.tokens('text')} <= {limit} THEN text {cases} "
            f"ELSE substr(text, 1, {keep}) || chr(10) || '...' || chr(10) || '{note}' END AS compact "
            f"FROM (SELECT doc_id, text, {cuts} FROM documents d {joins})")


@query("budget_300", _budget_sql(300))
def budget_300(spark, d):
    return docs(spark, d).select("doc_id", A.budget(F.col("text"), 300).alias("compact"))


@query("error_lines", f"""
SELECT doc_id, count(e.line) AS n_lines, coalesce(string_agg(e.line, chr(10) ORDER BY e.n), '') AS compact
FROM documents LEFT JOIN (SELECT * FROM {DOC_LINES} WHERE {B.is_error('line')}) e USING (doc_id)
GROUP BY doc_id""")
def error_lines(spark, d):
    return corpus.error_facts(docs(spark, d), ["doc_id"])


@query("binary_screen", f"""
SELECT kind, id, {B.binary_reason('t', 4000)} AS reason, {B.binary_reason('t', None)} AS whole_reason,
       CAST(greatest(1, length(t) // 1024) AS INT) AS kb FROM (
  SELECT 'doc' AS kind, doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN repeat('QUJD', 100 + CAST(doc_id % 50 AS INT)) || text
         WHEN doc_id % 11 = 0 THEN text || repeat(chr(2), 40) ELSE text END AS t FROM documents
  UNION ALL SELECT 'page', page_id, html FROM pages)""")
def binary_screen(spark, d):
    a = docs(spark, d).selectExpr(
        "'doc' AS kind", "doc_id AS id",
        "CASE WHEN doc_id % 7 = 0 THEN repeat('QUJD', 100 + CAST(doc_id % 50 AS INT)) || text "
        "WHEN doc_id % 11 = 0 THEN text || repeat(chr(2), 40) ELSE text END AS text")
    b = read(spark, d, "pages", wide=True).selectExpr("'page' AS kind", "page_id AS id", "html AS text")
    return corpus.binary_screen(a.unionByName(b)).drop("text")


# Texts of every shape, derived from four tables.
_SHAPED = """
  SELECT 'doc' AS kind, doc_id AS id, CASE
    WHEN doc_id % 13 = 1 THEN 'Traceback (most recent call last):' || chr(10) || text
    WHEN doc_id % 13 = 2 THEN 'diff --git a/x.py b/x.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b'
    WHEN doc_id % 13 = 3 THEN 'Epoch 1/3' || chr(10) || 'loss: 0.5' || chr(10) || 'Epoch 2/3' || chr(10) || 'loss: 0.4'
      || chr(10) || 'Epoch 3/3' || chr(10) || 'loss: 0.45' || chr(10) || text
    WHEN doc_id % 13 = 4 THEN 'Data columns (total 3 columns)' || chr(10) || text
    WHEN doc_id % 13 = 5 THEN 'precision recall f1-score' || chr(10) || 'cats       0.91      0.88      0.89       120' || chr(10) || text
    WHEN doc_id % 13 = 7 THEN 'Epoch 1/3' || chr(10) || 'loss: 0.5 precision: 0.7 recall: 0.6 f1-score: 0.65' || chr(10) || 'Epoch 2/3' || chr(10) || 'loss: 0.4'
      || chr(10) || 'Epoch 3/3' || chr(10) || 'loss: 0.3'
    WHEN doc_id % 13 = 6 THEN repeat('QUJD', 120) || text
    ELSE text END AS text FROM documents
  UNION ALL SELECT 'page' AS kind, page_id AS id, html AS text FROM pages
  UNION ALL SELECT 'event' AS kind, event_id AS id, props AS text FROM events
  UNION ALL SELECT 'turn' AS kind, conv_id * 1000 + turn AS id, text FROM conversations"""


def shaped(spark, d):
    for t in ("documents", "pages", "events", "conversations"):
        read(spark, d, t).createOrReplaceTempView(f"_shaped_{t}")
    sql = _SHAPED
    for t in ("documents", "pages", "events", "conversations"):
        sql = sql.replace(f"FROM {t}", f"FROM _shaped_{t}")
    return spark.sql(sql)


_STRIP = f"trim(text, {B.WS})"
_SHAPE_CASE = f"""CASE WHEN t = '' THEN 'empty'
  WHEN {B.binary_reason('t', None)} IS NOT NULL THEN 'binary'
  WHEN substr(t, 1, 1) IN ('{{', '[') AND json_valid(t) THEN 'json'
  WHEN contains(t, 'diff --git') OR regexp_matches(t, '(?m)^@@ .*@@') THEN 'diff'
  WHEN contains(t, 'pandas.core.frame.DataFrame') OR contains(t, 'Data columns (total') THEN 'frame_info'
  WHEN contains(t, 'precision') AND contains(t, 'recall') AND contains(t, 'f1-score')
    AND regexp_matches(t, {B.lit(P.REPORT_ROW)}) THEN 'class_report'
  WHEN len(regexp_extract_all(t, {B.lit(P.EPOCH_MARK)})) >= 3
    OR len(regexp_extract_all(t, {B.lit(P.EPOCH_LINE)})) >= 3 THEN 'training'
  WHEN contains(t, 'Traceback (most recent call last)') OR regexp_matches(t, {B.lit(P.FRAME_AT)})
    OR regexp_matches(t, {B.lit(P.FRAME_FILE)}) THEN 'trace'
  ELSE 'text' END"""


@query("classify_shape", f"""
SELECT kind, shape, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
  SELECT kind, id, {_SHAPE_CASE} AS shape FROM (SELECT kind, id, {_STRIP} AS t FROM ({_SHAPED})))
GROUP BY kind, shape""")
def classify_shape(spark, d):
    s = shaped(spark, d).select("kind", "id", shapes.classify_shape(F.col("text")).alias("shape"))
    return s.groupBy("kind", "shape").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _log_sql(rel: str, keys: str, limit: int) -> str:
    return B.head_tail(B.smart_lines(B.drop_progress(rel), keys), keys, limit)


@query("compact_log", f"SELECT * FROM {_log_sql(DOC_LINES, 'doc_id', 50)}")
def compact_log(spark, d):
    return docs(spark, d).select("doc_id", shapes.compact_log(F.col("text")).alias("compact"))


@query("compact_container_log", f"SELECT * FROM {_log_sql(DOC_LINES, 'doc_id', 45)}")
def compact_container_log(spark, d):
    return docs(spark, d).select("doc_id", shapes.compact_container_log(F.col("text")).alias("compact"))


@query("compact_journal", f"SELECT * FROM {B.head_tail(B.smart_lines(DOC_LINES, 'doc_id'), 'doc_id', 50)}")
def compact_journal(spark, d):
    return docs(spark, d).select("doc_id", shapes.compact_journal(F.col("text")).alias("compact"))


@query("compact_generic", f"""
SELECT * FROM {B.head_tail(B.dedup_lines(B.drop_progress(DOC_LINES), 'doc_id'), 'doc_id', 60)}""")
def compact_generic(spark, d):
    return docs(spark, d).select("doc_id", shapes.compact_generic(F.col("text")).alias("compact"))


# Flagship: deduplicate, cut, mask, never larger than raw, report by source.
_FLAG = f"""
  SELECT source, {B.tokens('text')} AS raw, {B.tokens('CASE WHEN NOT r AND length(m) > length(text) THEN text ELSE m END')} AS out
  FROM (SELECT source, text, {B.redact('compact')} AS m, {B.redact('compact')} <> compact AS r
        FROM documents JOIN {B.head_tail(B.smart_lines(DOC_LINES, 'doc_id'), 'doc_id', 60)} USING (doc_id))"""


def compacted_documents(spark, path_or_df):
    df = path_or_df
    compact = T.join_lines(A.head_tail(A.smart_dedup(T.split_lines(F.col("text")))))
    rows = df.select("doc_id", "source", "text", compact.alias("compact"))
    rows = corpus.redact_corpus(rows, "compact", strict=False)
    return rows.withColumn("out", A.size_floor(F.col("text"), F.col("masked"), F.col("redacted")))


@query("savings_report", f"""
SELECT source AS cmd, count(*) AS runs, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(out) AS BIGINT) AS out,
       CAST(sum(raw) - sum(out) AS BIGINT) AS saved,
       round(CASE WHEN sum(raw) = 0 THEN 0 ELSE (sum(raw) - sum(out)) * 100.0 / sum(raw) END, 4) AS pct
FROM ({_FLAG}) GROUP BY ROLLUP (source)""")
def savings_report(spark, d):
    rows = compacted_documents(spark, docs(spark, d))
    ledger = rows.select(F.col("source").alias("cmd"), T.est_tokens(F.col("text")).cast("bigint").alias("raw"),
                         T.est_tokens(F.col("out")).cast("bigint").alias("out"))
    return captures.savings_report(ledger).withColumn("pct", F.round("pct", 4))


@query("group_matches", f"""
SELECT doc_id, hits, rank, line_no, line FROM (
  SELECT doc_id, CAST(n AS BIGINT) AS line_no, substr(trim(line, {B.WS}), 1, 200) AS line,
         count(*) OVER (PARTITION BY doc_id) AS hits, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rank
  FROM {DOC_LINES} WHERE regexp_matches(line, 'Licen[sc]e')) WHERE rank <= 5""")
def group_matches(spark, d):
    hits = findings.find_lines(docs(spark, d), "Licen[sc]e", ["doc_id"])
    return findings.group_matches(hits, "doc_id")


@query("count_distinct_files", f"""
SELECT CAST(sum(c) AS BIGINT) AS matches, count(*) AS files FROM (
  SELECT doc_id, count(*) AS c FROM {DOC_LINES} WHERE regexp_matches(line, 'token|password') GROUP BY doc_id)""")
def count_distinct_files(spark, d):
    return findings.count_matches(findings.find_lines(docs(spark, d), "token|password", ["doc_id"]), "doc_id")


# --- auto_compact ------------------------------------------------------------

@query("auto_compact_text", f"""
SELECT doc_id, c AS compact, c <> compact AS redacted FROM (
  SELECT doc_id, compact, {B.redact('compact')} AS c FROM {_log_sql(
      B.lines_of(f"(SELECT doc_id, trim(text, {B.WS}) AS text FROM documents)", 'doc_id', 'text'), 'doc_id', 60)})""")
def auto_compact_text(spark, d):
    out = shapes.auto_compact(docs(spark, d), "doc_id", strict=False)
    return out.select("doc_id", "compact", "redacted")


@query("auto_compact")
def auto_compact(spark, d):
    keyed = shaped(spark, d).withColumn("key", F.concat("kind", F.lit("-"), F.col("id").cast("string")))
    out = shapes.auto_compact(keyed, "key")
    return corpus.savings_by(out, ["shape"], "text", "compact").withColumn("pct", F.round("pct", 4))


# --- pages -------------------------------------------------------------------

@query("html_corpus", f"SELECT page_id, {B.html_text('html')} AS visible FROM pages")
def html_corpus(spark, d):
    return corpus.html_corpus(read(spark, d, "pages", wide=True)).select("page_id", "visible")


@query("html_savings", f"""
SELECT host, count(*) AS runs, CAST(sum(r) AS BIGINT) AS raw, CAST(sum(o) AS BIGINT) AS out,
       CAST(sum(r) - sum(o) AS BIGINT) AS saved, round((sum(r) - sum(o)) * 100.0 / sum(r), 4) AS pct
FROM (SELECT {B.host('url')} AS host, {B.tokens('html')} AS r, {B.tokens(B.html_text('html'))} AS o FROM pages)
GROUP BY host""")
def html_savings(spark, d):
    p = corpus.html_corpus(read(spark, d, "pages", wide=True))
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")
    return corpus.savings_by(p, [host], "html", "visible").withColumn("pct", F.round("pct", 4))


# Every fifth page carries an inline image in front, every eleventh is nothing but one.
RESPONSES = Derived("pages", ("page_id", "CASE WHEN page_id % 11 = 0 THEN repeat('QUJD', 3000) WHEN page_id % 5 = 0 THEN "
                              "'<img src=\"' || repeat('QUJD', 110) || '\">' || html ELSE html END AS html"))
_RESP = f"""(SELECT page_id, string_agg(line, chr(10) ORDER BY n) AS t FROM {B.drop_progress(
    B.lines_of(RESPONSES.sql, 'page_id', 'html'))} GROUP BY page_id)"""


@query("compact_response", f"""
SELECT page_id, CASE WHEN {B.binary_reason('t', None)} IS NOT NULL THEN '[~' || greatest(1, length(t) // 1024)
    || 'KB of binary or base64-like content suppressed]' ELSE compact END AS compact
FROM {_RESP} JOIN {B.head_tail(B.lines_of(
    f"(SELECT page_id, CASE WHEN regexp_matches(t, {B.lit(P.HTML_PAGE)}) THEN {B.html_text('t')} ELSE t END AS v "
    f"FROM (SELECT page_id, {B.without_blobs('t')} AS t FROM {_RESP}))",
    'page_id', 'v'), 'page_id', 40)} USING (page_id)""")
def compact_response(spark, d):
    return RESPONSES.df(spark, d).select("page_id", shapes.compact_response(F.col("html")).alias("compact"))


URLS = Derived("pages", ("page_id", "regexp_replace(url, '[?#].*$', '') AS path"))
_BASE = "regexp_extract(path, '[^/]*$')"
_DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END"
_EXT = f"CASE WHEN contains({_BASE}, '.') THEN regexp_extract({_BASE}, '[^.]*$') ELSE '(none)' END"


@query("path_parts", f"SELECT page_id, {_DIR} AS dir, {_BASE} AS base, {_EXT} AS ext FROM {URLS.sql}")
def path_parts(spark, d):
    return corpus.split_path(URLS.df(spark, d)).drop("path")


@query("ext_histogram", f"SELECT {_EXT} AS ext, count(*) AS n FROM {URLS.sql} GROUP BY ext ORDER BY n DESC, ext LIMIT 8")
def ext_histogram(spark, d):
    return findings.ext_histogram(URLS.df(spark, d))


# Paths below the host, grouped by the host's top-level domain part.
SITE = Derived("pages", ("page_id", "page_id % 20 AS site",
                         "'site' || (page_id % 20) || '/' || CASE WHEN page_id % 3 = 0 AND page_id % 20 > 9 THEN 'en' ELSE 'all' END "
                         "|| '/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/', '') AS path"))
# Prefix level by level: a level is shared when all paths of the group agree.
_SEGS = f"(SELECT site, list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) AS s FROM {SITE.sql})"
_FOLD = f"""(SELECT site, paths, CASE WHEN paths >= 3 AND len(common) >= 2
    THEN array_to_string(common, '/') || '/' ELSE '' END AS prefix FROM (
  SELECT site, count(*) AS paths, list_transform(list_filter(range(1, CAST(min(len(s)) AS BIGINT) + 1),
      lambda i: len(list_distinct(list_transform(list(s), lambda x: list_slice(x, 1, i)))) = 1),
      lambda i: min(s)[i]) AS common FROM {_SEGS} GROUP BY site))"""


@query("fold_prefix", f"SELECT site, paths, prefix FROM {_FOLD}")
def fold_prefix(spark, d):
    return findings.fold_prefix(SITE.df(spark, d), ["site"])


@query("display_name_map", f"""
SELECT page_id, site, substr(path, length(prefix) + 1) AS display FROM {SITE.sql} JOIN {_FOLD} USING (site)""")
def display_name_map(spark, d):
    p = SITE.df(spark, d)
    return findings.display_names(p, findings.fold_prefix(p, ["site"]), ["site"]).select("page_id", "site", "display")


# --- conversations -----------------------------------------------------------

DIRTY = Derived("conversations", (
    "conv_id", "turn",
    "CASE WHEN turn % 3 = 0 THEN '﻿' ELSE '' END || chr(27) || '[31m' || role || chr(27) || '[0m' || chr(10) "
    "|| 'fetch 10%' || chr(13) || 'fetch 99%' || chr(13) || 'done' || chr(13) || chr(10) || text AS text"))
_NO_BOM = "CASE WHEN starts_with(text, '﻿') THEN substr(text, 2) ELSE text END"
_NO_ANSI = f"regexp_replace({_NO_BOM}, {B.lit(P.ANSI)}, '', 'g')"
_CLEAN = f"regexp_replace(replace({_NO_ANSI}, chr(13) || chr(10), chr(10)), '[^\\n]*\\r', '', 'g')"


@query("clean_control", f"""
SELECT conv_id, turn, {_CLEAN} AS text, CAST(length(text) - length({_NO_BOM}) AS INT) AS bom_chars,
       CAST(length({_NO_BOM}) - length({_NO_ANSI}) AS INT) AS ansi_chars,
       CAST(length({_NO_ANSI}) - length({_CLEAN}) AS INT) AS redraw_chars FROM {DIRTY.sql}""")
def clean_control(spark, d):
    return corpus.clean_text(DIRTY.df(spark, d))


PROGRESS = Derived("conversations", (
    "conv_id", "turn", B.text_of("'Downloading part ' || turn", "'===>  ' || (turn * 7 % 100) || '% done'", "''",
                                 "text", "'42% of checks failed: error ' || conv_id", "'Resolving deltas'", "'end'")
    + " AS text"))
_PROG = B.lines_of(PROGRESS.sql, "conv_id, turn", "text")


@query("drop_progress", f"SELECT * FROM {B.joined(B.drop_progress(_PROG), 'conv_id, turn')}")
def drop_progress(spark, d):
    return corpus.map_lines(PROGRESS.df(spark, d), A.drop_progress).select("conv_id", "turn", "compact")


_TURN = B.lines_of("conversations", "conv_id, turn", "text")
_OCC = f"(SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn, line ORDER BY n) AS occ FROM {_TURN})"


@query("line_difference", f"""
WITH cur AS (SELECT * FROM {_OCC}), prev AS (SELECT conv_id, turn + 1 AS turn, line, occ FROM {_OCC}),
pairs AS (SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, '-' AS sign, line, CAST(occ AS INT) AS occurrence FROM prev SEMI JOIN pairs USING (conv_id, turn)
  ANTI JOIN cur USING (conv_id, turn, line, occ)
UNION ALL
SELECT conv_id, turn, '+', line, CAST(occ AS INT) FROM cur SEMI JOIN pairs USING (conv_id, turn)
  ANTI JOIN prev USING (conv_id, turn, line, occ)""")
def line_difference(spark, d):
    pairs = versions.consecutive_pairs(read(spark, d, "conversations"), ["conv_id"], "turn", "text")
    return pairs.select("conv_id", "turn", F.inline(versions.snapshot_changes(F.col("old"), F.col("new"))))


_DIFFS = """
WITH o AS (SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn, line ORDER BY n) AS occ FROM {lines}),
prev AS (SELECT conv_id, turn + 1 AS turn, line, occ FROM o),
pairs AS (SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
ch AS (SELECT conv_id, turn, '-' AS sign, line, occ FROM prev ANTI JOIN o USING (conv_id, turn, line, occ)
  UNION ALL SELECT conv_id, turn, '+', line, occ FROM o ANTI JOIN prev USING (conv_id, turn, line, occ)),
g AS (SELECT conv_id, turn, count(*) AS c, string_agg(sign || {clip}, chr(10)
    ORDER BY sign DESC, encode(line), occ) AS diff FROM ch GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(c, 0) AS changes, CASE WHEN c BETWEEN 1 AND 12 THEN diff END AS diff
FROM pairs LEFT JOIN g USING (conv_id, turn)""".replace("{lines}", _TURN).replace("{clip}", "(" + B.clip("line") + ")")


@query("snapshot_diff", _DIFFS)
def snapshot_diff(spark, d):
    pairs = versions.consecutive_pairs(read(spark, d, "conversations"), ["conv_id"], "turn", "text")
    return versions.snapshot_diff(pairs).select("conv_id", "turn", "changes", "diff")
