"""Queries over captured runs; every order is one run with its own output."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T
from loomsift.operators import corpus, findings, profiles, runs
from loomsift.plans import captures, shapes
from loomsift.suite import base as B
from loomsift.suite.base import Derived, query, text_of

KEY = "o_orderkey AS capture_id"
CODE = "CASE WHEN o_orderstatus = 'F' THEN CAST(1 + o_custkey % 3 AS INT) ELSE 0 END AS code"
KIND = ("CASE o_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'build' WHEN 2 THEN 'install' "
        "WHEN 3 THEN 'pull' ELSE 'validate' END")

# --- outcomes ----------------------------------------------------------------

RUNS = Derived("orders", (
    KEY, CODE, f"{KIND} AS kind", text_of(
        "'Downloading dep ' || o_orderkey", "'start unit ' || o_orderpriority", "'62% ' || o_custkey",
        "CASE WHEN o_orderstatus <> 'F' THEN 'step done' WHEN o_custkey % 3 = 0 THEN '[ERROR] cannot resolve symbol s' || o_custkey "
        "WHEN o_custkey % 3 = 1 THEN 'fatal: bad object ' || o_custkey ELSE 'step done' END",
        "CASE WHEN o_orderstatus = 'F' AND o_custkey % 6 = 0 THEN '[ERROR] cannot resolve symbol s' || o_custkey ELSE 'unit ' || o_custkey END",
        "CASE WHEN o_orderstatus = 'F' THEN 'stopped' WHEN o_custkey % 4 = 0 THEN 'nothing to report' "
        f"ELSE CASE {KIND} WHEN 'test' THEN '== ' || (o_custkey % 50) || ' passed in 2s ==' "
        "WHEN 'build' THEN 'BUILD SUCCESS' || chr(10) || 'Total time:  ' || (o_custkey % 9) || ' s' "
        "WHEN 'install' THEN 'added ' || (o_custkey % 30) || ' packages' "
        "WHEN 'pull' THEN ' ' || (1 + o_custkey % 7) || ' files changed, 4 insertions' ELSE 'Success' END END",
        "'closing'") + " AS raw"))

_WITH_BODY = f"""
WITH lines AS {B.drop_progress(B.lines_of(RUNS.sql, 'capture_id, code, kind', 'raw'))},
body AS (SELECT capture_id, any_value(code) AS code, any_value(kind) AS kind, string_agg(line, chr(10) ORDER BY n) AS t,
  arg_max(line, n) AS last FROM lines GROUP BY capture_id),
errs AS {B.joined(B.error_context('lines', 'capture_id', 1), 'capture_id', name='e')},
merr AS {B.joined(B.dedup_lines("(SELECT * FROM lines WHERE starts_with(line, '[ERROR]'))", 'capture_id'), 'capture_id', name='m')}
"""
_BAD = "coalesce(e, t)"  # no run has more lines than the shortest head and tail


@query("run_outcome", f"""{_WITH_BODY}
SELECT capture_id, kind, code, CASE
  WHEN kind = 'test' AND code = 0 THEN 'PASSED' || coalesce('  (' || nullif(trim(regexp_extract(t, {B.lit(P.TEST_SUMMARY)}, 1),
    ' =-' || chr(9)), '') || ')', '')
  WHEN kind = 'test' THEN 'FAILED (exit ' || code || ')' || chr(10) || {_BAD}
  WHEN kind = 'build' AND code = 0 THEN CASE WHEN contains(t, 'BUILD SUCCESS')
    THEN 'ok -- BUILD SUCCESS  (' || trim(regexp_extract(t, 'Total time:\\s*([^\\n]+)', 1)) || ')' ELSE 'ok -- ' || last END
  WHEN kind = 'build' THEN 'FAILED' || chr(10) || coalesce(m, {_BAD})
  WHEN kind = 'install' AND code = 0 THEN 'ok' || coalesce(' -- ' || nullif(regexp_extract(t, {B.lit(P.INSTALL_OK)}, 1), ''), '')
  WHEN kind = 'install' THEN 'FAILED' || chr(10) || {_BAD}
  WHEN kind = 'pull' AND code = 0 THEN 'ok' || coalesce(' ' || nullif(regexp_extract(t, {B.lit(P.PULL_SUMMARY)}, 1), ''), '')
  WHEN kind = 'pull' THEN t
  WHEN code = 0 THEN 'valid' ELSE {_BAD} END AS outcome
FROM body LEFT JOIN errs USING (capture_id) LEFT JOIN merr USING (capture_id)""")
def run_outcome(spark, d):
    return runs.run_outcome(RUNS.df(spark, d)).select("capture_id", "kind", "code", "outcome")


@query("pass_rate", f"""
SELECT kind, count(*) AS runs, count(*) FILTER (code = 0) AS passed,
       round(count(*) FILTER (code = 0) * 100.0 / count(*), 2) AS pass_pct FROM {RUNS.sql} GROUP BY kind""")
def pass_rate(spark, d):
    return runs.pass_rate(RUNS.df(spark, d), ["kind"])


_RUN_LINES = B.lines_of(RUNS.sql, "capture_id, code", "raw")


@query("build_errors", f"""
SELECT capture_id, compact FROM {B.joined(B.dedup_lines(
    f"(SELECT * FROM {_RUN_LINES} WHERE starts_with(line, '[ERROR]'))", 'capture_id'), 'capture_id')}""")
def build_errors(spark, d):
    out = RUNS.df(spark, d).select("capture_id", runs.build_errors(F.col("raw")).alias("compact"))
    return out.where(F.col("compact").isNotNull())


@query("errors_only", f"""
SELECT capture_id, coalesce(e, '(no error lines detected)') AS compact FROM {RUNS.sql}
LEFT JOIN {B.joined(B.error_context(_RUN_LINES, 'capture_id', 1), 'capture_id', name='e')} USING (capture_id)""")
def errors_only(spark, d):
    return RUNS.df(spark, d).select("capture_id", shapes.errors_only(F.col("raw")).alias("compact"))


@query("fail_wrap", f"""
SELECT capture_id, CASE WHEN code <> 0 THEN coalesce(e, raw) ELSE raw END AS compact FROM {RUNS.sql}
LEFT JOIN {B.joined(B.error_context(_RUN_LINES, 'capture_id', 1), 'capture_id', name='e')} USING (capture_id)""")
def fail_wrap(spark, d):
    return RUNS.df(spark, d).select("capture_id", shapes.fail_wrap(F.col("raw"), F.col("raw"), F.col("code")).alias("compact"))


@query("error_lines_ctx1", f"""
SELECT capture_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY n) AS compact
FROM {B.error_context(_RUN_LINES, 'capture_id', 1)} GROUP BY capture_id""")
def error_lines_ctx1(spark, d):
    out = corpus.error_facts(RUNS.df(spark, d), ["capture_id"], "raw", context=1)
    return out.where(F.col("n_lines") > 0)


# --- test reports ------------------------------------------------------------

_T = "'test_' || (o_custkey % 40)"
TESTS = Derived("orders", (
    KEY, "CAST(1 AS INT) AS code", text_of(
        "'===== test session starts ====='", "'collected 4 items'", "'===== FAILURES ====='",
        f"'_____ TestA.' || {_T} || '[p' || o_orderkey || '] _____'", "'    def check():'",
        "'>       assert x == ' || o_orderkey", "'E       assert 1 == ' || o_orderkey", "''",
        "'tests/test_a.py:' || (o_orderkey % 90) || ': AssertionError'",
        "CASE WHEN o_orderkey % 3 = 0 THEN '____ test_only_block ____' || chr(10) || 'E   ValueError: bad' ELSE 'captured stdout' END",
        "'===== short test summary info ====='",
        f"'FAILED tests/test_a.py::TestA::' || {_T} || '[p' || o_orderkey || '] - assert 1 == ' || o_orderkey",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'ERROR tests/test_c.py::test_setup - boom' ELSE '' END",
        "'===== ' || (1 + o_custkey % 2) || ' failed, 2 passed in 0.12s ====='") + " AS raw"))
_FAILURES = f"""
SELECT o_orderkey AS capture_id, {_T} AS test, CAST(1 AS BIGINT) AS occurrence,
  'FAILED tests/test_a.py::TestA::' || {_T} || '[p' || o_orderkey || '] - assert 1 == ' || o_orderkey AS short,
  'E       assert 1 == ' || o_orderkey || chr(10) || 'tests/test_a.py:' || (o_orderkey % 90) || ': AssertionError' AS details
FROM orders
UNION ALL SELECT o_orderkey, 'test_only_block', 1, NULL, 'E   ValueError: bad' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'test_setup', 1, 'ERROR tests/test_c.py::test_setup - boom', NULL FROM orders WHERE o_orderkey % 2 = 0"""


@query("test_report", f"""
SELECT o_orderkey AS capture_id, (1 + o_custkey % 2) || ' failed, 2 passed in 0.12s' AS summary,
  CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS shorts, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS blocks FROM orders""")
def test_report(spark, d):
    rep = TESTS.df(spark, d).select("capture_id", runs.test_report(F.col("raw")).alias("r"))
    return rep.select("capture_id", "r.summary", F.size("r.shorts").alias("shorts"), F.size("r.blocks").alias("blocks"))


@query("failure_detail_match", _FAILURES)
def failure_detail_match(spark, d):
    return runs.test_failures(TESTS.df(spark, d), ["capture_id"])


@query("flaky_tests", f"""
SELECT test, count(*) AS failures, count(details) AS with_details FROM ({_FAILURES}) GROUP BY test""")
def flaky_tests(spark, d):
    return runs.flaky_tests(runs.test_failures(TESTS.df(spark, d), ["capture_id"]), ["capture_id"])


# Parametrised tests, one name in two classes, and more failures than are shown.
MANY = Derived("customer", (
    "c_custkey", text_of(
        "'===== FAILURES ====='", "'_____ TestA.test_one[b' || c_custkey || '] _____'", "'E       second ' || c_custkey", "'_____ TestA.test_one[a] _____'", "'E       first'",
        "'_____ TestB.test_two _____'", "'E       in B'", "'_____ TestC.test_two _____'", "'E       in C'", "'===== short test summary info ====='",
        "'FAILED t.py::TestA::test_one[a] - x'", "'FAILED t.py::TestA::test_one[b' || c_custkey || '] - x'", "'FAILED t.py::TestB::test_two - x'",
        "'FAILED t.py::TestC::test_two - x'",
        "repeat('FAILED t.py::test_many - x' || chr(10), CAST(10 + c_custkey % 5 AS INT)) || '===== 9 failed in 1.0s ====='") + " AS raw"))


@query("compact_test_many", """
SELECT c_custkey, 'FAILED (exit 1)' || chr(10) || '9 failed in 1.0s' || chr(10) || 'FAILED t.py::TestA::test_one[a] - x' || chr(10) || '  E       first' || chr(10)
  || 'FAILED t.py::TestA::test_one[b' || c_custkey || '] - x' || chr(10) || '  E       second ' || c_custkey || chr(10)
  || 'FAILED t.py::TestB::test_two - x' || chr(10) || '  E       in B' || chr(10) || 'FAILED t.py::TestC::test_two - x' || chr(10) || '  E       in C'
  || repeat(chr(10) || 'FAILED t.py::test_many - x', CAST(least(11, 10 + c_custkey % 5) AS INT))
  || CASE WHEN c_custkey % 5 > 1 THEN chr(10) || '...(+' || (c_custkey % 5 - 1) || ' more failures)' ELSE '' END AS compact FROM customer""")
def compact_test_many(spark, d):
    return MANY.df(spark, d).select("c_custkey", runs.compact_test(F.col("raw"), F.lit(1)).alias("compact"))


@query("compact_test", f"""
SELECT o_orderkey AS capture_id, 'FAILED (exit 1)' || chr(10) || (1 + o_custkey % 2) || ' failed, 2 passed in 0.12s' || chr(10)
  || 'FAILED tests/test_a.py::TestA::' || {_T} || '[p' || o_orderkey || '] - assert 1 == ' || o_orderkey || chr(10)
  || '  E       assert 1 == ' || o_orderkey || chr(10) || '  tests/test_a.py:' || (o_orderkey % 90) || ': AssertionError'
  || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'ERROR tests/test_c.py::test_setup - boom' ELSE '' END
  || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'FAILED test_only_block' || chr(10) || '  E   ValueError: bad' ELSE '' END AS compact
FROM orders""")
def compact_test(spark, d):
    return TESTS.df(spark, d).select("capture_id", runs.compact_test(F.col("raw"), F.col("code")).alias("compact"))


# --- training logs -----------------------------------------------------------

EPOCHS = 12


def _metric(i: int, a: int, b: int) -> str:
    return f"'0.' || lpad(CAST((o_orderkey * {a} + o_custkey * {b} + {i * i * 29}) % 1000 AS STRING), 3, '0')"


TRAINING = Derived("orders", (KEY, text_of("'run ' || o_orderkey", *[
    f"'Epoch {i}/{EPOCHS}' || chr(10) || 'step 3 - loss: ' || {_metric(i, 37, 11)} || ' - val_loss: ' || {_metric(i, 53, 7)} "
    f"|| ' - lr: 0.01'" for i in range(1, EPOCHS + 1)]) + " AS raw"))
_FACTS = f"""(SELECT o_orderkey AS capture_id, epoch, metric, CAST('0.' || lpad(CAST((o_orderkey *
    CASE metric WHEN 'loss' THEN 37 ELSE 53 END + o_custkey * CASE metric WHEN 'loss' THEN 11 ELSE 7 END
    + epoch * epoch * 29) % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS value
  FROM orders, range(1, {EPOCHS + 1}) e(epoch), (VALUES ('loss'), ('val_loss')) m(metric))"""
_SERIES = f"""(SELECT capture_id, metric, count(*) AS epochs, arg_min(value, epoch) AS first, arg_max(value, epoch) AS last,
  min(value) AS best, arg_min(epoch, (value, epoch)) AS best_epoch FROM {_FACTS} GROUP BY ALL)"""


@query("training_facts", f"SELECT capture_id, epoch, metric, value FROM {_FACTS}")
def training_facts(spark, d):
    return profiles.training_facts(TRAINING.df(spark, d), ["capture_id"])


@query("training_series", f"""
SELECT capture_id, metric, epochs, first, last, best, best_epoch, epochs - best_epoch AS since_best,
  epochs - best_epoch >= 5 AS plateau FROM {_SERIES}""")
def training_series(spark, d):
    return profiles.training_series(TRAINING.df(spark, d), ["capture_id"])


@query("training_summary", f"""
SELECT a.capture_id, CAST({EPOCHS} AS INT) AS epochs, a.first AS loss_first, a.last AS loss_last, b.first AS val_first, b.last AS val_last,
  'val_loss' AS best_metric, CAST(b.best_epoch AS INT) AS best_epoch, b.best AS best_value,
  CAST({EPOCHS} - b.best_epoch AS INT) AS since_best, {EPOCHS} - b.best_epoch >= 5 AS plateau
FROM {_SERIES} a JOIN {_SERIES} b USING (capture_id) WHERE a.metric = 'loss' AND b.metric = 'val_loss'""")
def training_summary(spark, d):
    c = TRAINING.df(spark, d).select("capture_id", profiles.training_curve(F.col("raw")).alias("c"))
    m = F.col("c.metrics")
    return c.select("capture_id", "c.epochs", m[0]["first"].alias("loss_first"), m[0]["last"].alias("loss_last"),
                    m[1]["first"].alias("val_first"), m[1]["last"].alias("val_last"), "c.best_metric", "c.best_epoch",
                    "c.best_value", "c.since_best", "c.plateau")


def _num(v: str) -> str:
    return f"regexp_replace(CAST({v} AS VARCHAR), '\\.0$', '')"


@query("train_run", f"""
SELECT capture_id, 'Training {EPOCHS} epochs (loss ' || {_num('a.first')} || '->' || {_num('a.last')} || ', val_loss '
  || {_num('b.first')} || '->' || {_num('b.last')} || ')' || chr(10) || 'Best: epoch ' || b.best_epoch || ' val_loss='
  || {_num('b.best')} || CASE WHEN {EPOCHS} - b.best_epoch >= 5 THEN ' | No improvement last ' || ({EPOCHS} - b.best_epoch)
  || ' epochs (early-stop candidate)' ELSE '' END AS compact
FROM {_SERIES} a JOIN {_SERIES} b USING (capture_id) WHERE a.metric = 'loss' AND b.metric = 'val_loss'""")
def train_run(spark, d):
    return TRAINING.df(spark, d).select("capture_id", shapes.train_run(F.col("raw")).alias("compact"))


# --- findings ----------------------------------------------------------------

LINT = Derived("orders", (KEY, "CAST(1 AS INT) AS code", text_of(
    "'src/app/mod_' || (o_custkey % 60) || '.py:' || (o_orderkey % 300 + 1) || ':' || (o_orderkey % 80) || ': E501 line too long ' || o_orderkey",
    "'src/web/view_' || (o_custkey % 9) || '.ts(' || (o_orderkey % 50) || ',5): error TS1005: expected'",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'pkg/core.py:' || (o_custkey % 200) || ': error: missing type' ELSE '' END",
    "'Found ' || (o_custkey % 3) || ' errors'") + " AS raw"))
_LL = f"(SELECT *, trim(line, {B.WS}) AS l FROM {B.lines_of(LINT.sql, 'capture_id', 'raw')})"
_FULL = f"(regexp_matches(l, {B.lit(P.LINT_HIT)}) AND regexp_extract(l, {B.lit(P.LINT_HIT)}, 1) <> '' AND NOT starts_with(l, '-'))"
_SHORT = f"regexp_matches(l, {B.lit(P.LINT_HIT_NO_COLUMN)})"


def _pick(i: int, j: int | None) -> str:
    short = f"regexp_extract(l, {B.lit(P.LINT_HIT_NO_COLUMN)}, {j})" if j else "NULL"
    return f"CASE WHEN {_FULL} THEN regexp_extract(l, {B.lit(P.LINT_HIT)}, {i}) ELSE {short} END"


_LINT_FACTS = f"""(SELECT capture_id, CAST(n - 1 AS BIGINT) AS pos, {_pick(1, 1)} AS file, CAST({_pick(2, 2)} AS BIGINT) AS line_no,
  CAST({_pick(3, None)} AS BIGINT) AS col_no, substr({_pick(4, 3)}, 1, 140) AS msg FROM {_LL} WHERE {_FULL} OR {_SHORT})"""


@query("lint_findings", f"SELECT * FROM {_LINT_FACTS}")
def lint_findings(spark, d):
    return findings.lint_findings(LINT.df(spark, d), ["capture_id"])


@query("group_lint", f"""
SELECT file, issues, rank, line_no, col_no, msg FROM (
  SELECT *, count(*) OVER (PARTITION BY file) AS issues, row_number() OVER (PARTITION BY file ORDER BY capture_id, pos) AS rank
  FROM {_LINT_FACTS}) WHERE rank <= 6""")
def group_lint(spark, d):
    return findings.group_lint(findings.lint_findings(LINT.df(spark, d), ["capture_id"]), ["capture_id", "pos"])


GREP = Derived("orders", (KEY, text_of(
    "'src/app/a_' || (o_custkey % 30) || '.py:' || (o_orderkey % 400) || ':  needle ' || o_orderpriority",
    "'src/app/b.py:7: x'", "''", "'Binary file matches'") + " AS raw"))
_GL = f"(SELECT * FROM {B.lines_of(GREP.sql, 'capture_id', 'raw')} WHERE line <> '')"


@query("parse_grep_output", f"""
SELECT capture_id, CAST(n - 1 AS BIGINT) AS pos, CASE WHEN h THEN regexp_extract(line, {B.lit(P.GREP_HIT)}, 1) END AS file,
  CASE WHEN h THEN CAST(regexp_extract(line, {B.lit(P.GREP_HIT)}, 2) AS BIGINT) END AS line_no,
  CASE WHEN h THEN substr(trim(regexp_extract(line, {B.lit(P.GREP_HIT)}, 3)), 1, 160) ELSE line END AS msg
FROM (SELECT *, regexp_matches(line, {B.lit(P.GREP_HIT)}) AS h FROM {_GL})""")
def parse_grep_output(spark, d):
    return findings.parse_grep_output(GREP.df(spark, d), ["capture_id"])


@query("compact_search", """
SELECT o_orderkey AS capture_id, '2 matches in 2 file(s)' || chr(10) || 'src/app/a_' || (o_custkey % 30) || '.py  (1)' || chr(10)
  || '  ' || (o_orderkey % 400) || ': needle ' || o_orderpriority || chr(10) || 'src/app/b.py  (1)' || chr(10) || '  7: x' AS compact
FROM orders""")
def compact_search(spark, d):
    return GREP.df(spark, d).select("capture_id", captures.compact_search(F.col("raw")).alias("compact"))


# --- diffs, commits, status --------------------------------------------------

_DIFF_LINES = (
    "CASE WHEN o_orderkey % 5 = 0 THEN '@@ -9 +9 @@' || chr(10) || '+z' || chr(10) ELSE '' END "
    "|| 'diff --git a/src/f' || (o_custkey % 10) || '.py b/src/f' || (o_custkey % 10) || '.py'",
    "'index 12ab..34cd 100644'", "'--- a/src/f' || (o_custkey % 10) || '.py'", "'+++ b/src/f' || (o_custkey % 10) || '.py'",
    "'@@ -1,4 +1,4 @@ def run():'", "' context'", "'-old ' || o_orderkey", "'+new ' || o_orderkey", "'+more'",
    "'--- a removed comment'", "' context'",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'diff --git a/README b/README' || chr(10) || 'new file mode 100644' || chr(10) "
    "|| '--- /dev/null' || chr(10) || '+++ b/README' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+hello' ELSE ' end' END")
DIFFS = Derived("orders", (KEY, text_of(*_DIFF_LINES) + " AS raw"))
_U = "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END"


@query("diff_stat", f"""
SELECT o_orderkey AS capture_id, CAST(0 AS BIGINT) AS pos, '' AS file, CAST(1 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed,
  CAST(2 AS BIGINT) AS changed_lines FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, {_U}, 'src/f' || (o_custkey % 10) || '.py', 2, 2, 5 FROM orders
UNION ALL SELECT o_orderkey, 1 + {_U}, 'README', 1, 0, 2 FROM orders WHERE o_orderkey % 2 = 0""")
def diff_stat(spark, d):
    return findings.diff_stat(DIFFS.df(spark, d), ["capture_id"])


@query("carry_forward_diff_files", """
SELECT file, CAST(sum(a) AS BIGINT) AS added, CAST(sum(r) AS BIGINT) AS removed, count(*) AS commits FROM (
  SELECT 'src/f' || (o_custkey % 10) || '.py' AS file, 2 AS a, 2 AS r FROM orders
  UNION ALL SELECT 'README', 1, 0 FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT '', 1, 0 FROM orders WHERE o_orderkey % 5 = 0) GROUP BY file""")
def carry_forward_diff_files(spark, d):
    stat = findings.diff_stat(DIFFS.df(spark, d), ["capture_id"])
    return stat.groupBy("file").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("commits"))


_COMPACT_DIFF = f"""(1 + {_U} + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) || ' file(s) changed' || chr(10)
  || CASE WHEN o_orderkey % 5 = 0 THEN '(unnamed)  (+1 -0)' || chr(10) || '  @@ -9 +9 @@' || chr(10) || '  +z' || chr(10) ELSE '' END
  || 'src/f' || (o_custkey % 10) || '.py  (+2 -2)' || chr(10) || '  @@ -1,4 +1,4 @@' || chr(10) || '  -old ' || o_orderkey || chr(10)
  || '  +new ' || o_orderkey || chr(10) || '  +more' || chr(10) || '  --- a removed comment'
  || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'README  (+1 -0)' || chr(10) || '  @@ -0,0 +1 @@' || chr(10) || '  +hello' ELSE '' END"""


@query("changed_lines", f"SELECT o_orderkey AS capture_id, {_COMPACT_DIFF} AS compact FROM orders")
def changed_lines(spark, d):
    return DIFFS.df(spark, d).select("capture_id", findings.compact_diff(F.col("raw")).alias("compact"))


SHOWS = Derived("orders", (KEY, text_of(
    "'commit ' || o_orderkey", "'Author: c' || o_custkey", "''", "'    change unit'",
    "CASE WHEN o_orderkey % 4 = 3 THEN 'no diff here' ELSE 'body' END") +
    " || CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE chr(10) || 'diff --git a/x.py b/x.py' || chr(10) || '--- a/x.py' || chr(10) "
    "|| '+++ b/x.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || o_custkey || chr(10) || '+b' END AS raw"))


@query("show_commit", """
SELECT o_orderkey AS capture_id, 'commit ' || o_orderkey || chr(10) || 'Author: c' || o_custkey || chr(10) ||
  CASE WHEN o_orderkey % 4 = 3 THEN chr(10) || '    change unit' || chr(10) || 'no diff here'
  ELSE '    change unit' || chr(10) || 'body' || chr(10) || '1 file(s) changed' || chr(10) || 'x.py  (+1 -1)' || chr(10)
    || '  @@ -1 +1 @@' || chr(10) || '  -a' || o_custkey || chr(10) || '  +b' END AS compact FROM orders""")
def show_commit(spark, d):
    return SHOWS.df(spark, d).select("capture_id", findings.compact_show(F.col("raw")).alias("compact"))


STATUS = Derived("orders", (KEY, text_of(
    "'## main...origin/main [ahead ' || (o_custkey % 5) || ']'", "' M src/a.py'", "'?? new_' || o_orderkey",
    "CASE o_orderstatus WHEN 'F' THEN 'D  gone.py' WHEN 'O' THEN 'A  fresh.py' ELSE 'R  old.py -> new.py' END",
    "CASE WHEN o_custkey % 2 = 0 THEN 'AM both.py' ELSE '' END") + " AS raw"))
_S = ("'main...origin/main [ahead ' || (o_custkey % 5) || ']' AS branch, CAST(1 + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) "
      "AS modified, CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS BIGINT) AS added, "
      "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS deleted, "
      "CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS BIGINT) AS renamed, CAST(1 AS BIGINT) AS untracked")


@query("status_rollup", f"SELECT o_orderkey AS capture_id, {_S} FROM orders")
def status_rollup(spark, d):
    return findings.status_rollup(STATUS.df(spark, d), ["capture_id"])


@query("compact_git", f"""
SELECT capture_id, 'git ' || CASE WHEN capture_id % 2 = 0 THEN 'status' ELSE 'diff' END AS label, CASE WHEN capture_id % 2 = 0 THEN
  'branch ' || branch || ' | ' || modified || 'M ' || added || 'A ' || deleted || 'D ' || renamed || 'R ' || untracked || ' untracked'
  || chr(10) || array_to_string(list_filter(string_split(raw, chr(10))[2:], lambda x: x <> ''), chr(10)) ELSE dc END AS compact
FROM (SELECT o_orderkey AS capture_id, {_S}, {_COMPACT_DIFF} AS dc FROM orders) JOIN {STATUS.sql} USING (capture_id)""")
def compact_git(spark, d):
    a = STATUS.df(spark, d).where("capture_id % 2 = 0").withColumn("sub", F.lit("status"))
    b = DIFFS.df(spark, d).where("capture_id % 2 = 1").withColumn("sub", F.lit("diff"))
    rows = a.unionByName(b)
    return rows.select("capture_id", F.concat(F.lit("git "), "sub").alias("label"),
                       captures.compact_by_rule(F.lit("git"), F.array(F.lit("git"), F.col("sub")), F.lit(0), F.col("raw")).alias("compact"))


# --- line filters ------------------------------------------------------------

DESCRIBE = Derived("supplier", ("s_suppkey AS capture_id", text_of(
    "'Name:         pod-' || s_suppkey", "'Namespace:    n' || s_nationkey", "'    Image: deep/' || s_suppkey", "'  Node:  n1'",
    "'   Too:  deep'", "'lower: no'", "'Status:       Running'",
    "CASE WHEN s_suppkey % 2 = 0 THEN 'Events:' || chr(10) || '  Warning  BackOff ' || s_suppkey || chr(10) || '   deep event' ELSE 'Tolerations: x' END")
    + " AS raw"))


@query("describe_fields", """
SELECT s_suppkey AS capture_id, 'Name:         pod-' || s_suppkey || chr(10) || 'Namespace:    n' || s_nationkey || chr(10) || '  Node:  n1'
  || chr(10) || 'Status:       Running' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'Events:' || chr(10) || '  Warning  BackOff '
  || s_suppkey || chr(10) || '   deep event' ELSE 'Tolerations: x' END AS compact FROM supplier""")
def describe_fields(spark, d):
    return DESCRIBE.df(spark, d).select("capture_id", shapes.describe_fields(F.col("raw")).alias("compact"))


UNIT = Derived("orders", (KEY, text_of(
    "'● unit-' || o_custkey || '.service - worker'", "'     Loaded: loaded (/etc/x)'", "'     Active: active (running)'",
    "'   Docs: man'", "'   Main PID: ' || o_orderkey || ' (x)'", "'line ' || o_orderpriority",
    "CASE WHEN o_orderstatus = 'F' THEN 'worker failed with code 3' ELSE 'fine' END") + " AS raw"))
_UL = B.lines_of(UNIT.sql, "capture_id", "raw")


@query("status_fields", f"""
SELECT * FROM {B.head_tail(f"(SELECT * FROM {_UL} WHERE regexp_matches(trim(line, {B.WS}), {B.lit(P.STATUS_FIELD)}) OR {B.is_error('line')})",
                           'capture_id', 30)}""")
def status_fields(spark, d):
    return UNIT.df(spark, d).select("capture_id", shapes.status_fields(F.col("raw")).alias("compact"))


PLAN_TEXT = Derived("orders", (KEY, text_of(
    "'Refreshing state ' || o_orderkey", "'  # res.a' || o_custkey || ' is tainted'", "'  + resource \"x\" \"y\" {'",
    "'      + name = ' || o_orderkey", "'-/+ resource \"z\" \"w\" {'", "'Plan: 1 to add'",
    "CASE WHEN o_orderstatus = 'F' THEN 'Error: cannot lock' ELSE 'Note: it will be made' END") + " AS raw"))
_PL = B.lines_of(PLAN_TEXT.sql, "capture_id", "raw")
_PS = f"trim(line, {B.WS})"


@query("plan_text_lines", f"""
SELECT * FROM {B.head_tail(f"(SELECT * FROM {_PL} WHERE regexp_matches({_PS}, {B.lit(P.PLAN_LINE)}) OR contains(line, 'Plan:') "
                           f"OR contains(line, 'will be') OR {B.is_error('line')})", 'capture_id', 50)}""")
def plan_text_lines(spark, d):
    return PLAN_TEXT.df(spark, d).select("capture_id", shapes.plan_text_lines(F.col("raw")).alias("compact"))


TRACE = Derived("orders", (KEY, text_of(
    "'Traceback (most recent call last):'", "'  File \"/app/main.py\", line ' || (o_orderkey % 90) || ', in run'", "'    x = step()'",
    "'  File \"/usr/lib/python3/site-packages/a/b.py\", line 1, in f'", "'    return g()'",
    "CASE WHEN o_custkey % 2 = 0 THEN '  File \"/x/node_modules/c.js\", line 2' ELSE '    at app.Main(Main.java:3)' END",
    "'  File \"/x/site-packages/d.py\", line 5'", "'  File \"/app/z.py\", line 9, in z'", "'plain note'",
    "'ValueError: bad value ' || o_custkey") + " AS raw"))
_TL = f"(SELECT *, trim(line, {B.WS}) AS s FROM {B.lines_of(TRACE.sql, 'capture_id', 'raw')})"
_KEEP = (f"(starts_with(s, 'File \"') OR starts_with(s, 'Traceback') OR starts_with(s, 'at ') OR starts_with(s, 'Caused by') "
         f"OR regexp_matches(s, {B.lit(P.EXCEPTION_LINE)}) OR {B.is_error('s')})")
_LIB = f"((starts_with(s, 'File \"') OR starts_with(s, 'at ')) AND regexp_matches(s, {B.lit(P.LIBRARY_FRAME)}))"


@query("trace_lines", f"SELECT * FROM {B.joined(f'(SELECT * FROM {_TL} WHERE {_KEEP})', 'capture_id')}")
def trace_lines(spark, d):
    return corpus.map_lines(TRACE.df(spark, d), A.trace_lines, "raw").select("capture_id", "compact")


_TRACE_RUNS = f"""(SELECT capture_id, min(n) AS n, CASE WHEN count(*) > 1 THEN '  ... [' || count(*) || ' library frames collapsed] ...'
    ELSE min(line) END AS line FROM (
  SELECT *, sum(CASE WHEN lib AND prev THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id ORDER BY n) AS g FROM (
    SELECT *, {_LIB} AS lib, coalesce(lag({_LIB}) OVER (PARTITION BY capture_id ORDER BY n), false) AS prev
    FROM {{rel}})) GROUP BY capture_id, g)"""


@query("lib_frame_runs", f"SELECT * FROM {B.joined(_TRACE_RUNS.replace('{rel}', _TL), 'capture_id')}")
def lib_frame_runs(spark, d):
    return corpus.map_lines(TRACE.df(spark, d), A.collapse_library_frames, "raw").select("capture_id", "compact")


@query("compact_trace", f"""
SELECT * FROM {B.head_tail(_TRACE_RUNS.replace('{rel}', f'(SELECT * FROM {_TL} WHERE {_KEEP})'), 'capture_id', 50)}""")
def compact_trace(spark, d):
    return TRACE.df(spark, d).select("capture_id", shapes.compact_trace(F.col("raw")).alias("compact"))


# --- aligned tables ----------------------------------------------------------

PODS = Derived("customer", ("c_custkey AS capture_id", "c_mktsegment AS segment", text_of(
    "'NAME   READY   STATUS   RESTARTS   AGE   NODE'", "'api-' || c_custkey || '   1/1   Running   0   5d   n' || c_nationkey",
    "'job-' || c_custkey || '   0/1   ' || CASE c_custkey % 3 WHEN 0 THEN 'Completed' WHEN 1 THEN 'CrashLoopBackOff' ELSE 'Running' END "
    "|| '   ' || (c_custkey % 4) || ' (2m ago)   3h   n1'",
    "CASE WHEN c_custkey % 5 = 0 THEN 'short-row   0/1' ELSE 'db-0   1/1   Pending   0   1m   n2' END") + " AS text"))
_PODS = """(
SELECT c_custkey AS capture_id, c_mktsegment AS segment, CAST(1 AS BIGINT) AS row_no, 'api-' || c_custkey AS name, 'Running' AS status,
  CAST(0 AS BIGINT) AS restarts, '5d' AS age, 'n' || c_nationkey AS node, false AS anomaly FROM customer
UNION ALL SELECT c_custkey, c_mktsegment, 2, 'job-' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Completed' WHEN 1 THEN 'CrashLoopBackOff'
  ELSE 'Running' END, c_custkey % 4, '3h', 'n1', c_custkey % 3 = 1 OR c_custkey % 4 > 0 FROM customer
UNION ALL SELECT c_custkey, c_mktsegment, 3, 'db-0', 'Pending', 0, '1m', 'n2', true FROM customer WHERE c_custkey % 5 <> 0)"""


@query("pod_rows", f"SELECT * EXCLUDE (segment) FROM {_PODS}")
def pod_rows(spark, d):
    return findings.pod_rows(PODS.df(spark, d), ["capture_id"])


@query("pod_anomalies", f"SELECT capture_id, name, status, restarts, age, node FROM {_PODS} WHERE anomaly")
def pod_anomalies(spark, d):
    return findings.pod_rows(PODS.df(spark, d), ["capture_id"]).where("anomaly") \
        .select("capture_id", "name", "status", "restarts", "age", "node")


@query("pod_summary", f"""
SELECT segment, status, count(*) AS pods, count(*) FILTER (anomaly) AS anomalies, CAST(sum(restarts) AS BIGINT) AS restarts
FROM {_PODS} GROUP BY segment, status""")
def pod_summary(spark, d):
    return findings.pod_summary(findings.pod_rows(PODS.df(spark, d), ["capture_id", "segment"]), ["segment"])


@query("compact_pods", f"""
SELECT capture_id, c || ' pods | ' || kinds || coalesce(chr(10) || bad, '') AS compact FROM (
  SELECT capture_id, sum(c) AS c, string_agg(c || ' ' || status, ', ' ORDER BY c DESC, f) AS kinds FROM (
    SELECT capture_id, status, count(*) AS c, min(row_no) AS f FROM {_PODS} GROUP BY ALL) GROUP BY capture_id)
LEFT JOIN (SELECT capture_id, string_agg('! ' || name || '  ' || status || '  restarts=' || restarts || '  age=' || age || '  node=' || node,
  chr(10) ORDER BY row_no) AS bad FROM {_PODS} WHERE anomaly GROUP BY capture_id) USING (capture_id)""")
def compact_pods(spark, d):
    return PODS.df(spark, d).select("capture_id", findings.compact_pods(F.col("text")).alias("compact"))


TABLE = Derived("customer", ("c_custkey AS capture_id", text_of(
    "'  CONTAINER ID   IMAGE  STATUS   NAMES  '", "'------------   -----  ------   -----'", "''",
    "'ab' || c_custkey || '   img:' || c_nationkey || '   Up 2 days   web' || c_custkey",
    "'odd row   ' || c_custkey", "'cd' || c_custkey || '   img:2   Exited   job'") + " AS text"))


@query("read_text_table", """
SELECT c_custkey AS capture_id, CAST(2 AS BIGINT) AS row_no, 'img:' || c_nationkey AS image, 'Up 2 days' AS status, 4 AS width FROM customer
UNION ALL SELECT c_custkey, 3, CAST(c_custkey AS VARCHAR), NULL, 2 FROM customer
UNION ALL SELECT c_custkey, 4, 'img:2', 'Exited', 4 FROM customer""")
def read_text_table(spark, d):
    t = findings.read_text_table(TABLE.df(spark, d), ["capture_id"])
    return t.select("capture_id", "row_no", findings.cell("image").alias("image"), findings.cell("STATUS").alias("status"),
                    F.size("cells").alias("width"))


@query("compact_table", """
SELECT c_custkey AS capture_id, 'IMAGE  STATUS  NAMES' || chr(10) || 'img:' || c_nationkey || '  Up 2 days  web' || c_custkey || chr(10)
  || 'odd row   ' || c_custkey || chr(10) || 'img:2  Exited  job' AS compact FROM customer""")
def compact_table(spark, d):
    return TABLE.df(spark, d).select("capture_id", findings.compact_table(F.col("text"), ["container id"]).alias("compact"))


@query("drop_separator_rows", f"""
SELECT capture_id, CAST(count(*) AS BIGINT) AS kept FROM {B.lines_of(TABLE.sql, 'capture_id', 'text')}
WHERE NOT regexp_matches(line, {B.lit(P.SEPARATOR_ROW)}) AND line <> '' GROUP BY capture_id""")
def drop_separator_rows(spark, d):
    body = F.filter(findings.table_lines(F.col("text")), lambda x: ~x.rlike(P.SEPARATOR_ROW))
    return TABLE.df(spark, d).select("capture_id", F.size(body).cast("bigint").alias("kept"))


@query("size_floor", f"""
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND length(text) < length(c) THEN text ELSE c END AS compact
FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE substr(text, 1, 10) END AS c FROM documents)""")
def size_floor(spark, d):
    rows = B.read(spark, d, "documents").selectExpr(
        "doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE substr(text, 1, 10) END AS c")
    return rows.select("doc_id", A.size_floor(F.col("text"), F.col("c"), F.col("doc_id") % 3 == 0).alias("compact"))
