"""Jobs over captures, payloads, reports and files."""

import json
import re
import types

import pytest
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift import suite
from loomsift.functions import text as T
from loomsift.operators import corpus, files, findings, jsonops, profiles, runs
from loomsift.plans import captures, rules, shapes
from loomsift.session import shared_dir, spread
from loomsift.sources import readers, writers
from loomsift.suite.runs import RUNS

DIFF = """diff --git a/app.py b/app.py
index 1..2 100644
--- a/app.py
+++ b/app.py
@@ -1,5 +1,5 @@ def main():
 ctx
 ctx
-old
+new
 ctx"""

PODS = """NAME     READY   STATUS             RESTARTS   AGE
web-1    1/1     Running            0          5d
web-2    0/1     CrashLoopBackOff   7          1h"""

PYTEST = """===== test session starts =====
collected 13 items
===== FAILURES =====
_____ TestA.test_one[x] _____

    def test_one():
>       assert 1 == 2
E       assert 1 == 2

tests/test_a.py:10: AssertionError
_____ test_two _____
E   ValueError: bad
===== short test summary info =====
FAILED tests/test_a.py::TestA::test_one[x] - assert 1 == 2
FAILED tests/test_a.py::test_two - ValueError: bad
===== 2 failed, 11 passed in 0.12s ====="""


def best_log():
    lines = []
    for i in range(1, 101):
        lines.append(f"Epoch {i}/100")
        loss = 1.0 / i
        val = 0.2 + abs(i - 41) * 0.01
        lines.append(f"45/45 - loss: {loss:.4f} - val_loss: {val:.4f}")
    return "\n".join(lines)


def test_diff(apply):
    out = apply(findings.compact_diff, DIFF, "no diff", "@@ -1 +1 @@\n-a\n+b",
                "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1 +1 @@\n--- gone\n+++ kept")
    assert out[0] == "1 file(s) changed\napp.py  (+1 -1)\n  @@ -1,5 +1,5 @@\n  -old\n  +new"
    assert out[1] == "no changes"
    assert out[2].startswith("1 file(s) changed\n(unnamed)  (+1 -1)")
    assert "q.sql  (+1 -1)" in out[3] and "--- gone" in out[3]


def test_plan(spark, apply):
    plan = {"resource_changes": [
        {"address": "aws.a", "change": {"actions": ["create"], "before": None, "after": {"name": "n"}}},
        {"address": "aws.b", "change": {"actions": ["update"], "before": {"size": "s", "password": "x"},
                                        "after": {"size": "m", "password": "y"}}},
        {"address": "gcp.c", "change": {"actions": ["delete"], "before": {"x": "1"}, "after": None}},
        {"address": "aws.d", "change": {"actions": ["no-op"], "before": {}, "after": {}}}]}
    out = apply(captures.compact_plan_json, json.dumps(plan), "not a plan")
    assert out[0] == ("Plan: 1 add, 1 change, 1 destroy\n+ aws.a n\n~ aws.b\n    size: s->m\n    password: <redacted>\n- gcp.c")
    assert out[1] is None
    docs = spark.createDataFrame([(1, json.dumps(plan))], "id int, text string")
    only = jsonops.plan_changes(docs, ["id"], include=["^aws"])
    assert [r.address for r in only.orderBy("pos").collect()] == ["aws.a", "aws.b"]
    gone = jsonops.attr_diff(jsonops.plan_changes(docs, ["id"]), ["address"], removed=True)
    assert {(r.address, r.attr, r.old, r.new) for r in gone.collect()} >= {("gcp.c", "x", "1", None)}


def test_pods(spark, apply):
    assert apply(findings.compact_pods, PODS, PODS.replace("CrashLoopBackOff   7", "Running            0"), "x") == [
        "2 pods | 1 Running, 1 CrashLoopBackOff\n! web-2  CrashLoopBackOff  restarts=7  age=1h", "2 pods | 2 Running", None]
    rows = findings.pod_rows(spark.createDataFrame([(1, PODS)], "id int, text string"), ["id"]).collect()
    assert [(r.name, r.restarts, r.anomaly) for r in rows] == [("web-1", 0, False), ("web-2", 7, True)]


def test_table(apply):
    table = "CONTAINER ID   IMAGE   STATUS\nabc            nginx   Up\n---   ---   ---\nodd row"
    assert apply(lambda c: findings.compact_table(c, ["CONTAINER ID"]), table) == "IMAGE  STATUS\nnginx  Up\nodd row"


def test_training(spark, apply):
    log = best_log()
    curve = apply(profiles.training_curve, log)
    assert (curve.best_epoch, curve.since_best, curve.plateau, curve.epochs) == (41, 59, True, 100)
    text = apply(profiles.compact_training, log)
    assert "Best: epoch 41 val_loss=0.2" in text and len(text) < len(log) * 0.05
    plain = "\n".join(f"it {i} train_loss={10 - i}" for i in range(6))
    assert apply(profiles.training_curve, plain).metrics[0].last == 5.0
    assert apply(profiles.training_curve, "nothing here") is None
    many = "\n".join(f"Epoch {i}/2 f1: 1 auc: 2 loss: {3 - i} mse: 4 acc: 5 r2: 6" for i in (1, 2))
    assert [m.metric for m in apply(profiles.training_curve, many).metrics] == ["loss", "acc", "f1", "auc", "mse", "r2"]
    assert apply(profiles.compact_training, many).startswith("Training 2 epochs (loss 2->1, acc 5->5, f1 1->1, auc 2->2)")
    twice = spark.createDataFrame([(1, "Epoch 1/2\nloss: 3\nloss: 2 acc: 1\nEpoch 2/2\nloss: 1")], "id int, raw string")
    facts = {(r.epoch, r.metric, r.value) for r in profiles.training_facts(twice, ["id"]).collect()}
    assert facts == {(1, "loss", 2.0), (1, "acc", 1.0), (2, "loss", 1.0)}


def test_test_report(spark, apply):
    out = apply(lambda c: runs.compact_test(c, F.lit(1)), PYTEST)
    assert out.split("\n")[:2] == ["FAILED (exit 1)", "2 failed, 11 passed in 0.12s"]
    assert "  E       assert 1 == 2" in out and "  tests/test_a.py:10: AssertionError" in out and "collected" not in out
    rows = runs.test_failures(spark.createDataFrame([(1, PYTEST)], "id int, raw string"), ["id"]).collect()
    assert {r.test: r.details for r in rows} == {
        "test_one": "E       assert 1 == 2\ntests/test_a.py:10: AssertionError", "test_two": "E   ValueError: bad"}
    quiet = apply(runs.test_report, "F.\n1 failed, 2 passed in 0.01s")
    assert quiet.summary == "1 failed, 2 passed in 0.01s" and not quiet.blocks
    assert apply(lambda c: runs.compact_test(c, F.lit(0)), "=== 3 passed in 1s ===") == "PASSED  (3 passed in 1s)"


@pytest.mark.parametrize("kind,code,raw,want", [
    ("build", 0, "[INFO] x\nBUILD SUCCESS\nTotal time:  3.2 s", "ok -- BUILD SUCCESS  (3.2 s)"),
    ("build", 0, "BUILD SUCCESSFUL in 2s\n3 tasks", "ok -- BUILD SUCCESSFUL in 2s"),
    ("build", 1, "[INFO] a\n[ERROR] bad\n[ERROR] bad\nmore", "FAILED\n[ERROR] bad  (x2)"),
    ("test", 0, "12 passed in 1s", "PASSED  (12 passed in 1s)"), ("test", 2, "a\nb", "FAILED (exit 2)\na\nb"),
    ("install", 0, "added 5 packages in 2s", "ok -- added 5 packages in 2s"),
    ("pull", 0, "x\n 2 files changed, 3 insertions(+)", "ok 2 files changed, 3 insertions(+)"),
    ("validate", 0, "anything", "valid")])
def test_outcomes(spark, kind, code, raw, want):
    df = spark.createDataFrame([(kind, code, raw)], "kind string, code int, raw string")
    assert runs.run_outcome(df).first().outcome == want


def test_lint(spark, apply):
    text = "src/app/a.py:1:2: E1 x\nsrc/app/b.ts(3,4): error TS1\nsrc/app/c.py:9: note\nnoise"
    out = apply(lambda c: captures.compact_lint(c, F.lit(1)), text)
    assert out.startswith("3 issue(s) in 3 file(s)\nin src/app/\na.py  (1)\n  1:2 E1 x")
    assert apply(lambda c: captures.compact_lint(c, F.lit(0)), "") == "clean"


def test_json_profile(spark):
    doc = {"password": "x", "name": "n" * 70, "nested": {"apiKey": "k", "count": 2}, "items": [{"v": 1}, {"v": 2}, {"v": 3}]}
    rows = jsonops.json_profile(spark.createDataFrame([(1, "﻿" + json.dumps(doc))], "id int, text string"), ["id"]).collect()
    got = {r.path: (r.type, r.sample, r.n_items) for r in rows}
    assert got["$.password"] == ("redacted", "<redacted>", None) and got["$.nested.apiKey"][1] == "<redacted>"
    assert got["$.name"][1] == "n" * 57 + "..." and got["$.items"] == ("array", None, 3)
    assert got["$.items[].v"] == ("number", "1", None) and got["$.nested.count"][1] == "2"


def test_json_in_linear_time(spark):
    """16,000 distinct keys take seconds; 5,000 levels are kept; what lies deeper is reported."""
    import time

    wide = json.dumps({f"k{i}": {"v": i, "w": [i]} for i in range(16_000)})
    deep = '{"a":' * 5000 + '{"password":"hunter2","n":1.50}' + "}" * 5000
    deeper = "[" * 7000 + "]" * 7000
    beyond = '{"a":' * 50_000 + "1" + "}" * 50_000
    docs = spark.createDataFrame([(1, wide), (2, deep), (3, deeper), (4, beyond), (5, deep[:-1]), (6, '{"a":1,"a":2,"b":-0.10,"c":1e3,"d":"\\ud800"}'), (7, '{"a":NaN}'),
                                  (8, '{"n":' + "9" * 5000 + "}")], "id int, text string").repartition(2)
    start = time.perf_counter()
    out = {r.id: r.compact for r in jsonops.json_compact(docs, "id").collect()}
    assert time.perf_counter() - start < 20
    assert len(out[1].split("\n")) == 48_000 and "$.k15999.w[]=15999" in out[1]
    assert out[2] == "$" + ".a" * 5000 + ".n=1.5\n$" + ".a" * 5000 + ".password=<redacted>"
    assert out[3].split("\n")[-1].endswith("[]=[...]") and len(out[3].split("\n")) == 6001 and out[4] == "$={...}"
    assert set(out) == {1, 2, 3, 4, 6, 8} and out[6] == "$.a=2\n$.b=-0.1\n$.c=1000.0\n$.d=?" and out[8] == "$.n=" + "9" * 5000


def test_text_like_json_leaves_masked(spark):
    """Under the rule ``json`` a broken or bottomless document is no way around the mask."""
    caps = [(1, ["json", "f"], 0, '{"password":"hunter2" ' + "x y, " * 100), (2, ["json", "f"], 0, '{"a":' * 20_000 + '{"password":"hunter2"}' + "}" * 20_000),
            (3, ["json", "f"], 0, '{"a":' * 1005 + '{"password":"hunter2"}' + "}" * 1005)]
    rows = captures.compact_captures(spark.createDataFrame(caps, "capture_id long, argv array<string>, code int, raw string")).collect()
    assert all("hunter2" not in r.compact for r in rows) and [r.redacted for r in sorted(rows, key=lambda r: r.capture_id)] == [True, False, True]
    docs = spark.createDataFrame([(c[0], c[3]) for c in caps], "id long, text string")
    auto = {r.id: r for r in shapes.auto_compact(docs, "id").collect()}
    assert all("hunter2" not in r.compact for r in auto.values()) and auto[3].shape == "json" and auto[1].shape == "text"


def test_json_of_any_depth_keeps_everything(spark):
    deep = "[" * 40 + "1" + "]" * 40
    odd = '{"a":{},"b":null,"c":[],"x":{"y":{"password":{"z":1}}}}'
    docs = spark.createDataFrame([(1, deep), (1, odd), (2, "no json"), (3, None)], "id int, text string")
    rows = jsonops.json_profile(docs, ["id"])
    assert rows.count() == 41 + 7
    out = [r.compact for r in jsonops.json_compact(docs, "id").collect()]
    assert out[0].endswith("$" + "[]" * 40 + "=1") and out[1] == "$.a={}\n$.b=null\n$.c=(0 items)\n$.x.y.password=<redacted>"
    assert [(r.key, r.n) for r in jsonops.secret_keys(docs).collect()] == [("password", 1)]


def test_plans_hide_nested_values(spark, apply):
    change = {"actions": ["update"], "before": {"env": {"k": {"password": "old1"}}, "list": [1, 2], "n": 1}, "after": {
        "env": {"k": {"password": "hunter2"}}, "list": [1, 2, {"token": "t0p"}], "n": 2}}
    text = json.dumps({"resource_changes": [{"address": "aws.a", "change": change}, {"address": "gcp.b", "change": change}]})
    out = apply(captures.compact_plan_json, text)
    assert "hunter2" not in out and "old1" not in out and "t0p" not in out and "env: {...}->{...}" in out and "list: [2]->[3]" in out and "n: 1->2" in out
    some = apply(lambda c: captures.compact_plan_json(c, include=["^aws"]), text)
    assert some.startswith("Plan: 0 add, 1 change, 0 destroy") and "gcp" not in some
    rows = jsonops.attr_diff(jsonops.plan_changes(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]), ["id", "address"]).collect()
    assert rows and not any(x in str(r) for r in rows for x in ("hunter2", "old1", "t0p"))


def test_shapes(apply):
    texts = ["", "  ", "a\x00b", '{"a":1}', "{not json", DIFF, "Data columns (total 3 columns):",
             "precision recall f1-score support\n  cats  0.9  0.8  0.85  12", best_log() + "\nprecision recall f1-score", "Traceback (most recent call last):\n  x", "plain"]
    assert apply(shapes.classify_shape, *texts) == [
        "empty", "empty", "binary", "json", "text", "diff", "frame_info", "class_report", "training", "trace", "text"]


def test_auto_compact(spark):
    big = json.dumps([{"id": i, "secretAccessKey": "s" * 20} for i in range(20)])
    docs = spark.createDataFrame([(1, big), (2, "a\nDB_PASSWORD=hunter2\nb"), (3, "x = 1\ny = 2"), (4, best_log())],
                                 "id int, text string")
    out = {r.id: r for r in shapes.auto_compact(docs, "id").collect()}
    assert "(20 items)" in out[1].compact and "ssss" not in out[1].compact and len(out[1].compact) < 0.2 * len(big)
    assert "hunter2" not in out[2].compact and out[2].redacted
    assert out[3].compact == "x = 1\ny = 2" and not out[3].redacted
    assert out[4].compact.startswith("Training 100 epochs")


def capture_rows():
    log = "\n".join(f"2026-01-01T10:00:{i % 60:02d}Z tick" for i in range(200))
    bad = "\n".join([f"line {i}" for i in range(100)] + ["ERROR: boom"])
    return [
        (1, ["git", "diff"], 0, DIFF), (2, ["kubectl", "get", "pods"], 0, PODS), (3, ["pytest", "-q"], 1, PYTEST),
        (4, ["log", "app.log"], 0, log), (5, ["kubectl", "logs", "x"], 1, bad), (6, ["vim", "x"], 0, "as is"),
        (7, ["npm", "test"], 1, bad), (8, ["trim", "-"], 0, "token = abcdef\nok"), (9, ["json", "f"], 0, '{"apiKey":"v","n":1}'),
        (10, ["proxy", "ls"], 0, "a\na"), (11, ["find", "."], 0, "src/app/a.py\nsrc/app/b.py\nsrc/app/c.md"),
        (12, ["curl", "u"], 0, "<html><body><p>hi</p><script>x</script></body></html>"), (13, ["ls", "-la"], 0, ""),
        (14, ["terraform", "plan"], 0, "Refreshing\n  # a.b will be created\nPlan: 1 to add"),
        (15, ["git", "commit", "-m", "x"], 0, "[main abc1234] x\n 1 file changed"), (16, ["err", "make"], 0, "fine"),
        (17, ["systemctl", "status", "x"], 0, "● x.service\n   Active: active\n   Docs: man"),
        (18, ["train", "python"], 0, best_log()), (19, ["docker", "ps"], 0, "CONTAINER ID   IMAGE\nabc            nginx")]


@pytest.fixture(scope="module")
def captured(spark):
    return spark.createDataFrame([(i, a, c, r) for i, a, c, r in capture_rows()],
                                 "capture_id bigint, argv array<string>, code int, raw string") \
        .withColumn("ts", F.lit("2026-01-01 00:00:00").cast("timestamp"))


def test_compact_captures(captured):
    rows = captures.compact_captures(captured).collect()
    out = {r.capture_id: r for r in rows}
    assert len(rows) == len(capture_rows())
    assert out[1].compact == DIFF or out[1].compact.startswith("1 file(s) changed")
    assert out[2].compact.startswith("2 pods")
    assert out[3].compact.startswith("FAILED (exit 1)\n2 failed")
    assert out[4].compact.endswith("tick  (x200)")
    assert out[5].compact == "line 99\nERROR: boom\n[full output: kubectl_logs_x.log]" and out[5].tee
    assert out[6].compact == "as is" and out[6].rule is None
    assert out[7].label == "npm test" and out[16].label == "err make" and out[10].label == "proxy ls" and out[7].rule == "test" and "ERROR: boom" in out[7].compact
    assert "abcdef" not in out[8].compact and out[8].redacted
    assert '"v"' not in out[9].compact and "<redacted>" in out[9].compact
    assert out[10].compact == "a\na"
    assert out[12].compact == "hi" and "Plan: 1 to add" in out[14].compact and out[15].compact == "ok abc1234"
    assert out[16].compact == "fine" and "Docs" not in out[17].compact and out[18].compact.startswith("Training 100")
    assert out[19].compact == "IMAGE\nnginx"
    for r in rows:
        # Never larger than raw, unless secrets were taken out or a note was added.
        assert r.redacted or r.tee or len(r.compact) <= len(r.raw)


def test_tee_modes_and_budget(captured):
    never = captures.compact_captures(captured, tee_mode="never", budget=50).collect()
    assert not any(r.tee for r in never)
    assert all((len(r.compact) + 3) // 4 <= 50 for r in never if r.rule)
    always = captures.compact_captures(captured, tee_mode="always", exclude=["git"]).collect()
    assert all(r.tee == (r.rule is not None) for r in always)
    assert [r.rule for r in always if r.argv[0] == "git"] == [None, None]


def test_captures_without_a_rule_pass_untouched(spark):
    long = "\n".join(f"line {i}" for i in range(300))
    rows = [(i, argv, code, long) for i, argv in enumerate((["vim", "x"], ["git", "log"], ["nope"])) for code in (0, 1)]
    rows = [(10 * i + c, a, c, t) for i, a, c, t in rows] + [(100, ["vim", "x"], 0, long)]
    df = spark.createDataFrame(rows, "capture_id bigint, argv array<string>, code int, raw string").withColumn(
        "ts", F.timestamp_seconds(F.col("capture_id")))
    out = captures.compact_captures(df, budget=20, tee_mode="always", exclude=["git"], session_cache=True, redact_all=True).collect()
    assert len(out) == len(rows) and all(r.compact == r.raw and not r.tee and not r.redacted for r in out)


def test_errors_are_read_after_cleaning(spark):
    raw = "Downloading 10%\nnoise\nDownloading 55%\nerror: boom\nDownloading 99%\nend"
    df = spark.createDataFrame([(1, ["npm", "test"], 1, raw)], "capture_id bigint, argv array<string>, code int, raw string").withColumn(
        "ts", F.timestamp_seconds(F.lit(0)))
    assert "Downloading" not in captures.compact_captures(df).first().compact


def test_cloud_presets_in_the_row(spark):
    cluster = json.dumps({"name": "c1", "location": "eu", "tags": {"env": "x"}, "adminPassword": "hide me", "agentPoolProfiles": [
        {"name": "sys", "count": 3, "vmSize": "Standard_D4s", "osType": "Linux", "mode": "System"}], "pad": "p" * 400})
    cost = json.dumps({"properties": {"columns": [{"name": "Cost"}, {"name": "ResourceGroup"}], "rows": [[1.5, "a"], [2, "b"], ["x", "c"]], "pad": "p" * 300}})
    rows = [(1, ["az", "aks", "show"], 0, cluster), (2, ["az", "costmanagement", "query"], 0, cost), (3, ["aws", "ec2", "describe"], 0, cluster)]
    df = spark.createDataFrame(rows, "capture_id bigint, argv array<string>, code int, raw string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    out = {r.capture_id: r for r in captures.compact_captures(df, resource_exclude=["^b$"]).collect()}
    assert out[1].compact == "AKS c1 | eu | k8s ? | ?/?\nPools: sys(3xD4s,Linux,System)\nIdentity: ? | no AAD | networkPlugin: ?\ntags: env=x"
    assert out[1].label == "az aks show" and out[2].compact == "Cost total: 1.50 (1 groups)\n  a: 1.50" and out[2].redacted
    assert out[3].label == "aws" and "hide me" not in out[3].compact and "$.adminPassword=<redacted>" in out[3].compact


def test_session_cache(spark):
    text = "\n".join(f"row {i}" for i in range(30))
    rows = [(1, 0, text), (2, 100, text), (3, 200, text.replace("row 7", "ROW 7")), (4, 5000, text), (5, 5100, text)]
    df = spark.createDataFrame([(i, ["proxy", "x"], 0, r, t) for i, t, r in rows],
                               "capture_id bigint, argv array<string>, code int, raw string, t bigint") \
        .withColumn("ts", F.timestamp_seconds("t")).drop("t")
    out = {r.capture_id: r.compact for r in captures.compact_captures(df, session_cache=True).collect()}
    assert out[1] == text and out[2] == "(unchanged since 100s ago)"
    assert out[3] == "(changed since 200s ago)\n-row 7\n+ROW 7"
    assert out[4] == text and out[5] == "(unchanged since 100s ago)"


def test_rules(spark):
    df = spark.createDataFrame([(["npm", "test"],), (["npm", "i"],), (["nope"],), ([],)], "argv array<string>")
    assert [r.rule for r in rules.rule_lookup(df).collect()] == ["test", "package", None, None]
    own = spark.createDataFrame([("nope", None, "log")], "word1 string, word2 string, rule string")
    assert rules.rule_lookup(df, own).where("rule = 'log'").count() == 1
    twice = spark.createDataFrame([("npm", None, "b"), ("npm", None, "a"), ("nope", None, "log"), (None, "x", "y")], "word1 string, word2 string, rule string")
    assert sorted(str(r.rule) for r in rules.rule_lookup(df, twice).collect()) == ["None", "a", "log", "test"]


def test_sources_and_sinks(spark, captured):
    done = captures.compact_captures(captured).cache()
    ledger, tee, out, raw = (shared_dir(spark, n) for n in ("l", "t", "o", "r"))
    writers.append_ledger(done, ledger)
    rows = {r.cmd: r for r in captures.savings_report(readers.read_ledger(spark, ledger), 1.0).collect()}
    assert rows[None].runs == 19 and rows[None].raw == sum(r.raw for c, r in rows.items() if c)
    assert rows["log"].saved > 0 and rows["log"].money == pytest.approx(rows["log"].saved / 1000)
    writers.write_tee(done, tee)
    kept = {r.capture_id: r.raw for r in spark.read.parquet(tee).collect()}
    assert kept[5] == capture_rows()[4][3]
    writers.write_compact(done, out)
    assert all(r.compact.endswith("\n") for r in spark.read.parquet(out).collect())
    captured.withColumn("raw", F.concat(F.lit("\x1b[1m"), "raw")).write.parquet(raw)
    assert {r.raw for r in readers.read_captures(spark, raw).collect()} == {r[3] for r in capture_rows()}


def test_a_repeated_run_leaves_each_row_once(spark, captured):
    done = captures.compact_captures(captured).cache()
    ledger, tee, out = (shared_dir(spark, n) for n in ("l", "t", "o"))
    for run, rows in (("a", done), ("b", done.where("code <> 0")), ("a", done)):
        writers.append_ledger(rows, ledger, run)
        writers.write_tee(rows, tee, "always", run)
        writers.write_compact(rows, out, run)
    n = done.count() + done.where("code <> 0").count()
    assert readers.read_ledger(spark, ledger).count() == spark.read.parquet(tee).count() == spark.read.parquet(out).count() == n
    with pytest.raises(ValueError):
        writers.append_ledger(done, ledger, "a/b")


def test_invalid_bytes_are_repaired_at_the_door(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok \xff\x1b[1mbold")), (2, None)], "capture_id int, raw binary")
    assert [r.raw for r in readers.clean_captures(df).orderBy("capture_id").collect()] == ["ok \ufffdbold", ""]


def test_ledger_skips_bad_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"t":1,"cmd":"a","raw":10,"out":4}\nbroken\n{"t":2,"cmd":"b","raw":5,"out":5}\n')
    assert {r.cmd for r in readers.read_ledger(spark, str(tmp_path)).collect()} == {"a", "b"}


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "core.py").write_text("import os\n\nclass A:\n    def f(self):\n        return 1\n")
    (tmp_path / "notes.txt").write_bytes(b"bad \xff byte")
    (tmp_path / "node_modules" / "x.js").write_text("function f() {}")
    lines = readers.read_lines(spark, str(tmp_path)).where("stream LIKE '%.py'").orderBy("chunk", "at")
    assert [r.line for r in lines.collect()] and lines.columns == ["stream", "chunk", "line", "at"]
    inv = readers.scan_files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in inv.collect()] == ["notes.txt", "core.py"]
    docs = readers.read_documents(spark, str(tmp_path))
    table = docs.withColumn("path", F.regexp_replace("path", f"^file:(//)?{tmp_path}", "repo"))
    assert table.where("path = 'repo/notes.txt'").first().text == "bad \ufffd byte"
    rows = files.code_map(table).collect()
    assert {r.line for r in rows if r.kind == "signature"} == {"class A:", "def f(self):"}
    assert {(r.dir, r.n) for r in rows if r.kind == "dir"} == {("repo", 1), ("repo/src", 1)}
    sig = files.signature_lines(table).where("path LIKE '%core.py'").first()
    assert sig.compact == "# repo/src/core.py  (6 lines -> 3 signatures)\nimport os\nclass A:\n    def f(self):"
    hits = findings.find_lines(table, "class", ["path"])
    assert findings.count_matches(hits, "path").first() == (1, 1)
    assert [r.line_no for r in findings.find_lines(table, r"(?<!\s)class", ["path"]).collect()] == [3]
    assert files.view_file(table, 2).where("path LIKE '%core.py'").first().compact.startswith("import os\n... [4 lines omitted] ...")


def test_bad_files_keep_their_row(spark, tmp_path):
    """An unreadable, an invalid and a large file: a row for each, and no failure; an empty one has none."""
    (tmp_path / "fine.txt").write_text("fine")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "invalid.txt").write_bytes(b"a\xffb")
    (tmp_path / "large.txt").write_text("x" * 5000)
    (tmp_path / "torn.txt").write_text("torn")
    # A checksum file that does not fit makes the local file system refuse the read.
    (tmp_path / ".torn.txt.crc").write_bytes(b"crc\x00" + (512).to_bytes(4, "big") + b"\x00" * 4)
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.read_documents(spark, str(tmp_path), max_bytes=1000).collect()}
    assert rows == {"fine.txt": ("fine", None), "invalid.txt": ("a\ufffdb", None),
                    "large.txt": (None, "too large"), "torn.txt": (None, "unreadable")}


def test_listing_shows_directories_first(spark):
    paths = [("b.txt",), ("a.txt",), ("z/one.py",), ("m/two.py",), ("m/three.py",)]
    rows = findings.listing(findings.path_rollup(spark.createDataFrame(paths, "path string"))).collect()
    assert [(r.kind, r.name) for r in rows if r.dir == "."] == [("summary", ""), ("dir", "m"), ("dir", "z"), ("file", "a.txt"), ("file", "b.txt")]
    assert [(r.kind, r.name) for r in rows if r.dir == "m"] == [("summary", ""), ("file", "three.py"), ("file", "two.py")]


def test_profiles(spark):
    df = spark.createDataFrame([(1, None if i % 3 == 0 else 1.0, "x") for i in range(30)], "id int, price double, name string")
    got = {r.column: (r.nulls, r.flag) for r in profiles.null_profile(df).collect()}
    assert got == {"id": (0, False), "price": (10, True), "name": (0, False)}
    assert {r.dtype: r.columns for r in profiles.dtype_counts(df).collect()} == {"int": 1, "double": 1, "string": 1}
    pairs = [("cat", "cat")] * 90 + [("cat", "dog")] * 10 + [("dog", "dog")] * 84 + [("dog", "cat")] * 16
    rep = profiles.class_report(spark.createDataFrame(pairs, "l string, p string"), "l", "p").first()
    assert rep.accuracy == pytest.approx(0.87) and rep.worst_class == "dog" and rep.worst_recall == pytest.approx(0.84)


def test_token_meter(spark):
    docs = spark.createDataFrame([("a", "x" * 40), ("a", "x" * 4), ("b", "")], "source string, text string")
    got = {r.source: (r.docs, r.tokens, r.p95_tokens) for r in corpus.token_meter(docs, ["source"]).collect()}
    assert got == {"a": (2, 11, 10), "b": (1, 0, 0)}
    saved, pct = T.saved_columns(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(saved, pct).first()) == (0, 0.0)


def test_cluster_tags(spark):
    docs = spark.createDataFrame([(1, json.dumps({"name": "c", "tags": {"env": "x", "team": "y"}})), (2, '{"name":"d"}')], "id int, text string")
    assert {r.id: r.tags for r in jsonops.cluster_rows(docs, ["id"]).collect()} == {1: {"env": "x", "team": "y"}, 2: None}


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_read_files_and_folders(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, f"line {i}\nline {i}") for i in range(9)], "doc_id bigint, text string")
    if parts:
        rows.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    out = {r.doc_id: r.compact for r in suite.queries()["stream_compact"](spark, str(tmp_path)).collect()}
    assert out == {i: f"line {i}  (x2)" for i in range(9)}


def test_read_captures_reads_every_run_of_its_table(spark, tmp_path):
    orders = [(1, 4, "O", "1-URGENT"), (2, 6, "F", "2-HIGH"), (3, 7, "P", "3-MEDIUM")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    want = {r.capture_id: (r.code, len(r.raw)) for r in RUNS.df(spark, str(tmp_path)).collect()}
    got = suite.queries()["read_captures"](spark, str(tmp_path)).collect()
    assert len(got) == 3 and {r.capture_id: (r.code, r.chars) for r in got} == want


def test_training_series_in_the_row(spark):
    """Odd logs against a plain reading, and no exchange below the summaries."""
    logs = ["loss: 9 Epoch 1/3 - Loss = 0.5 loss:0.25\nval_loss\t:\t1e-1 x1loss: 2 3acc=.5\nlr: 1\nEPOCH 2 / 3\nloss:\n0.7\nloss: 1e999 a: 1e5b: 2\nEpoch 3/3\n",
            "acc: 1\nloss=2 acc=3\nnone\nmy_loss: +4 eta: 3 loss: 2", "", "a/b", "loss: 1", "épochs 1/2\nEpoch 1/2\néloss: 3\nEpoch 2/2 Epoch 9/9 loss: 3"]
    want = {}
    for key, log in enumerate(logs):
        lines = log.split("\n")
        marks = [i for i, x in enumerate(lines) if re.search(P.EPOCH_MARK, x)]
        pieces = [lines[a:b] for a, b in zip([0, *marks], [*marks, len(lines)])] if marks else [[x] for x in lines]
        epochs = [[(n.lower(), float(v)) for x in piece for n, v in re.findall(P.METRIC, x, re.A) if n.lower() not in P.METRIC_SKIP] for piece in pieces]
        epochs = [e for e in epochs if e and (marks or any("loss" in n for n, _ in e))]
        for metric in {n for e in epochs for n, _ in e}:
            s = [(i, dict(e)[metric]) for i, e in enumerate(epochs, 1) if metric in dict(e)]
            best, at = min((v, i) for i, v in s)
            want[key, metric] = (len(s), s[0][1], s[-1][1], best, at, s[-1][0] - at, s[-1][0] - at >= max(5, len(s) // 10))
    df = spark.createDataFrame(list(enumerate(logs)), "id int, raw string")
    out = profiles.training_series(df, ["id"])
    assert {(r.id, r.metric): tuple(r)[2:] for r in out.collect()} == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    from_facts = profiles.series_summary(profiles.training_facts(df, ["id"]), ["id", "metric"])
    assert {(r.id, r.metric): tuple(r)[2:] for r in from_facts.collect()} == want


def test_large_tables_of_narrow_rows_are_dealt_finer(spark):
    df = spark.range(1000).repartition(4)
    assert [spread(df, deal).rdd.getNumPartitions() for deal in (1, 8)] == [4, 32]
    assert spread(spark.range(10).coalesce(1), 8).rdd.getNumPartitions() == 4


def test_failures_meet_in_the_row(spark):
    rows = [(1, PYTEST), (2, "===== FAILURES =====\n__ no __\n____ A.t[x] ____\nE  one\n____ B.t ____\nE  two\n____ u ____\n===== short =====\n"
             "FAILED a.py::t[x] - m\nERROR a.py::v\nFAILED a.py::t - m\nFAILED a.py::t - n"), (3, "nothing"), (4, "")]
    out = runs.test_failures(spark.createDataFrame(rows, "id int, raw string"), ["id"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.test, r.occurrence): (r.short, r.details) for r in out.collect()}
    assert {k: v for k, v in got.items() if k[0] != 1} == {
        (2, "t", 1): ("FAILED a.py::t[x] - m", "E  one"), (2, "t", 2): ("FAILED a.py::t - m", "E  two"),
        (2, "t", 3): ("FAILED a.py::t - n", None), (2, "u", 1): (None, ""), (2, "v", 1): ("ERROR a.py::v", None)}
    assert {k[1:] for k in got if k[0] == 1} == {("test_one", 1), ("test_two", 1)} and dict(out.dtypes)["occurrence"] == "bigint"


def test_a_document_is_opened_once(spark):
    docs = spark.createDataFrame([(1, '{"a": [1]}'), (2, "no"), (3, None), (4, "{}")], "id int, text string").repartition(3)
    out = jsonops.json_compact(docs, "id")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.id: r.compact for r in out.collect()} == {1: "$.a=(1 items)\n$.a[]=1", 4: "$={}"}


def test_wide_documents_are_read_member_by_member(spark):
    texts = ['{"b": {"x": 1.50, "token": "t"}, "a": [{"y": null}], "b": 2, "o1": {"z": 1}, "o10": "\\ud800", "o1.z": true}', "{}", " { } ", "[1, 2]", "no", "{", '{"a": 1} x',
             '{"a": 1,}', '{"a" 1}', '{a: 1}', '{"a": NaN}', '{"password": {"x": 1}, "e": {}}', "﻿{\"a\": \"\"}", "3", "[]", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    want = {r.id: r.compact for r in jsonops.json_compact(docs, "id").collect()}
    assert {r.id: r.compact for r in jsonops.json_compact_wide(docs, "id").collect()} == want and len(want) == 8
    plain = jsonops._members('{"k": 1, "k": 2, "l": 3}')
    assert isinstance(plain, types.GeneratorType) and list(plain) == [("k", "2"), ("l", "3")]
