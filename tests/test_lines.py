"""Line-table operators against sequential brute force, on a hot stream."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomsift.operators import lines as L
from loomsift.operators import versions as V
from loomsift.plans import rules
from loomsift.streaming.jobs import changed_lines, stream_session_cache


@pytest.fixture(scope="module")
def log(spark):
    """One stream with most rows and three small ones, in uneven chunks."""
    rng = random.Random(11)
    rows = []
    for stream, size in (("hot", 900), ("b", 40), ("c", 1), ("d", 130)):
        chunk, t = 0, 0
        for n in range(size):
            if rng.random() < 0.15:
                chunk += rng.choice([1, 1, 3])
            t += rng.choice([0, 1, 5, 5, 40, 200])
            line = rng.choice(["a", "a", "a", "b", "", "error x"]) if n % 97 > 30 else "same"
            rows.append((stream, chunk, n, line, t))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "s string, chunk int, n int, line string, t bigint").repartition(7).cache(), \
        {s: sorted([r for r in rows if r[0] == s], key=lambda r: r[2]) for s in ("hot", "b", "c", "d")}


def runs_of(rows, merge_blank=True):
    out = []
    for r in rows:
        if out and out[-1][1] == r[3] and (merge_blank or r[3].strip()):
            out[-1][2] += 1
        else:
            out.append([r[2], r[3], 1])
    return out


@pytest.mark.parametrize("merge_blank", [True, False])
def test_islands(log, merge_blank):
    df, by = log
    got = {(r.s, r.n0, r.line, r.n) for r in L.islands(
        df.withColumnRenamed("n", "n0"), ["s"], "chunk", ["n0"], merge_blank=merge_blank).collect()}
    assert got == {(s, *r) for s, rows in by.items() for r in runs_of(rows, merge_blank)}


def test_smart_dedup(log):
    df, by = log
    got = {(r.s, r.n0, r.line) for r in L.smart_dedup(
        df.withColumnRenamed("n", "n0"), ["s"], "chunk", ["n0"], F.col("line")).collect()}
    want = set()
    for s, rows in by.items():
        runs = runs_of(rows, merge_blank=False)
        total = {}
        for _, k, c in runs:
            total[k] = total.get(k, 0) + c
        seen = set()
        for n, k, c in runs:
            if k.strip() and total[k] >= 4 and total[k] > c:
                if k not in seen:
                    seen.add(k)
                    want.add((s, n, f"{k}  (x{total[k]} total)"))
            else:
                want.add((s, n, f"{k}  (x{c})" if c > 1 else k))
    assert got == want


@pytest.mark.parametrize("k", [1, 2, 5])
def test_context(log, k):
    df, by = log
    got = {(r.s, r.n) for r in L.context_rows(df, ["s"], "chunk", ["n"], F.col("line") == "error x", k).collect()}
    want = {(s, rows[j][2]) for s, rows in by.items() for i, r in enumerate(rows) if r[3] == "error x"
            for j in range(max(0, i - k), min(len(rows), i + k + 1))}
    assert got == want


def test_carry_block_number(log):
    df, by = log
    carried = {(r.s, r.n): r.carried for r in L.carry_forward(
        df, ["s"], "chunk", ["n"], F.when(F.col("line") == "b", F.col("n"))).collect()}
    blocks = {(r.s, r.n): r.block for r in L.block_id(df, ["s"], "chunk", ["n"], F.col("line") == "b").collect()}
    numbers = {(r.s, r.n): r.pos for r in L.number_lines(df, ["s"], "chunk", ["n"], "pos").collect()}
    for s, rows in by.items():
        last, count = None, 0
        for i, r in enumerate(rows):
            if r[3] == "b":
                last, count = r[2], count + 1
            assert carried[s, r[2]] == last and blocks[s, r[2]] == count and numbers[s, r[2]] == i + 1


@pytest.mark.parametrize("size", [1, 7, 250, 65536])
def test_chunks_cut_here(log, monkeypatch, size):
    """Without a chunk column the operators cut their own, of any size, with the same answers."""
    df, by = log
    df = df.drop("chunk")
    cut = L.range_chunks
    chunks = cut(df, ["s"], ["n"], size=size).groupBy("s", "chunk").agg(F.count("*").alias("c"), F.min("n").alias("a"), F.max("n").alias("b"))
    spans = sorted((r.s, r.chunk, r.a, r.b, r.c) for r in chunks.collect())
    assert max(r[4] for r in spans) <= size and sum(r[4] for r in spans) == sum(map(len, by.values()))
    assert all(x[0] != y[0] or x[3] < y[2] for x, y in zip(spans, spans[1:]))
    monkeypatch.setattr(L, "range_chunks", lambda *a, **k: cut(*a, **k, size=size))
    numbers = L.number_lines(df, ["s"], None, ["n"], "pos")
    assert numbers.columns == [*df.columns, "pos"]
    got = {(r.s, r.n): r.pos for r in numbers.collect()}
    carried = {(r.s, r.n): r.carried for r in L.carry_forward(df, ["s"], None, ["n"], F.when(F.col("line") == "b", F.col("n"))).collect()}
    blocks = {(r.s, r.n): r.block for r in L.block_id(df, ["s"], None, ["n"], F.col("line") == "b").collect()}
    near = {(r.s, r.n) for r in L.context_rows(df, ["s"], None, ["n"], F.col("line") == "error x", 2).collect()}
    runs = {(r.s, r.at, r.line, r.n) for r in L.islands(df.withColumnRenamed("n", "at"), ["s"], None, ["at"]).collect()}
    for s, rows in by.items():
        last, count = None, 0
        for i, r in enumerate(rows):
            if r[3] == "b":
                last, count = r[2], count + 1
            assert (carried[s, r[2]], blocks[s, r[2]], got[s, r[2]]) == (last, count, i + 1)
    assert near == {(s, rows[j][2]) for s, rows in by.items() for i, r in enumerate(rows) if r[3] == "error x"
                    for j in range(max(0, i - 2), min(len(rows), i + 3))}
    assert runs == {(s, *r) for s, rows in by.items() for r in runs_of(rows)}


def test_chunks_of_an_empty_table_and_null_keys(spark):
    none = spark.createDataFrame([], "s string, n int, line string")
    assert L.number_lines(none, ["s"], None, ["n"], "pos").collect() == []
    with pytest.raises(Exception, match="null in key column s"):
        L.number_lines(spark.createDataFrame([(None, 1)], "s string, n int"), ["s"], None, ["n"], "pos").collect()


@pytest.mark.parametrize("limit", [1, 2, 30, 40, 129, 130, 131])
def test_head_tail(log, limit):
    df, by = log
    got = {(r.s, r.slot): r.line for r in L.head_tail(df, ["s"], ["n"], limit).collect()}
    for s, rows in by.items():
        text = [r[3] for r in rows]
        head = limit * 2 // 3
        want = text if len(text) <= limit else (
            text[:head] + [f"... [{len(text) - limit} lines omitted] ..."] + text[len(text) - (limit - head):])
        assert [got[s, i + 1] for i in range(len(want))] == want
        assert len([1 for k in got if k[0] == s]) == len(want)


def test_session_fold(spark, log):
    _, by = log
    ttl, day = 300, 1000
    rows = [(s, r[2], r[4], r[3], r[4] // day) for s, rs in by.items() for r in rs]
    df = spark.createDataFrame(rows, "s string, id int, t bigint, hash string, day bigint").repartition(5)
    got = {(r.s, r.id): (r.status, r.age) for r in V.session_fold(df, ["s"], ["t", "id"], ttl=ttl).collect()}
    for s, rs in by.items():
        at = content = None
        for r in rs:
            t, h = r[4], r[3]
            fresh = at is not None and t - at < ttl
            if fresh and h == content:
                want = ("unchanged", t - at)
            else:
                want = ("changed", t - at) if fresh else ("new", None)
                at, content = t, h
            assert got[s, r[2]] == want


def plain_fold(rows, ttl):
    """Statuses of sorted (t, id, content) runs of one key, with the id of the run before."""
    at = content = before = None
    out = {}
    for t, i, h in rows:
        fresh = at is not None and t - at < ttl
        if fresh and h == content:
            out[i] = ("unchanged", t - at, before)
        else:
            out[i] = ("changed", t - at, before) if fresh else ("new", None, before)
            at, content = t, h
        before = i
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("kind", ["mixed", "one segment", "null content"])
def test_session_fold_over_ranges(spark, parts, kind):
    """One key holds most runs, also with one content all along: ranges inside a segment pass the entry on."""
    rng = random.Random(parts)
    rows, t = [], 0
    for i in range(700):
        t += rng.choice([0, 0, 1, 3, 9] if kind == "one segment" else [0, 1, 5, 40, 200])
        h = "x" if kind == "one segment" else rng.choice(["x", "x", "x", "y", None if kind == "null content" else "z"])
        rows.append(("hot" if i % 10 else f"k{i % 3}", i, t, h))
    df = spark.createDataFrame(rows, "s string, id int, t bigint, hash string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = V.session_fold(df, ["s"], ["t", "id"], ttl=60, previous=["id", "hash"])
        assert out.columns == ["s", "id", "t", "hash", "status", "age", "prev_id", "prev_hash"]
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    content = {i: h for _, i, _, h in rows}
    for s in {r[0] for r in rows}:
        want = plain_fold(sorted((t, i, h) for k, i, t, h in rows if k == s) if kind != "null content" else
                          sorted(((t, i, h) for k, i, t, h in rows if k == s), key=lambda r: r[:2]), 60)
        assert {r.id: (r.status, r.age, r.prev_id) for r in got if r.s == s} == want
    assert all(r.prev_hash == content.get(r.prev_id) for r in got)


def test_session_fold_plan(spark, log):
    """Two passes over what was written, and few exchanges; nothing for an empty table; a null key fails."""
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 6, "x"), ("b", 3, 7, "x")], "s string, id int, t bigint, hash string")
    out = V.session_fold(df, ["s"], ["t", "id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition 1") <= 3 and plan.count("Relation") <= 3 and "Window" not in plan
    assert V.session_fold(df.limit(0), ["s"], ["t", "id"]).collect() == []
    with pytest.raises(Exception, match="null in key column s"):
        V.session_fold(spark.createDataFrame([(None, 1, 5, "x")], df.schema), ["s"], ["t", "id"])


def test_explode_and_first(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\n")], "id int, text string")
    assert [tuple(r) for r in L.explode_lines(docs, keep=["id"]).collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "")]
    first = L.first_occurrence(L.explode_lines(docs, keep=["id"]), ["id"], ["at"]).collect()
    assert {(r.line, r.at, r.n) for r in first} == {("a", 1, 2), ("b", 2, 1), ("", 4, 1)}


def test_snapshot_changes(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "a\nB\nc"), (2, "a", "a"), (3, "a\na\nb", "b\na"),
                                  (4, "\n".join(map(str, range(20))), "x")], "i int, old string, new string")
    got = {r.i: (r.changes, r.diff) for r in V.snapshot_diff(rows).collect()}
    assert got == {1: (2, "-b\n+B"), 2: (0, None), 3: (1, "-a"), 4: (21, None)}


def test_pattern_tables_of_any_length(spark):
    names = spark.createDataFrame([("aws.web",), ("gcp.db",), ("aws.tmp",), (None,)], "name string")
    inc = spark.createDataFrame([("^aws",), (None,)], "pattern string")
    exc = spark.createDataFrame([("tmp$",)], "pattern string")
    for constants in (1000, 0):
        assert [r.name for r in rules.pattern_semi_anti(names, "name", inc, exc, constants=constants).collect()] == ["aws.web"]
        assert rules.pattern_semi_anti(names, "name", inc.limit(0), constants=constants).count() == 0


def test_literals_of_patterns(spark):
    rows = [("^aws.web$", ["aws", "web"]), ("abcd+e", ["abc", "bcd"]), ("abcd?", ["abc"]), ("ab.*cd", []), ("abc|d", []), ("abc\\.d", []),
            ("(?i)abc", []), ("abc{2}", []), ("abc++d", []), ("x*abc", ["abc"]), ("", []), (".+?abc", [])]
    df = spark.createDataFrame(rows, "p string, want array<string>").select("p", "want", rules.pattern_literals(F.col("p")).alias("got"))
    assert not [r for r in df.collect() if r.got != r.want]


def test_many_patterns_meet_names_through_their_literals(spark):
    import re

    names = [f"{a}-{b}.{i}" for i in range(20) for a in ("aws", "gcp", "ab") for b in ("web", "db", "cache")] + ["", "ab"]
    patterns = ["^aws-web", "cache.1$", "gc?p-d", "zzz", "aws-zzz", "b.3$", "(db|xx).7", "web+.5", "^ab$", "d*b.11"]
    df, table = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    hit = {n for n in names if any(re.search(p, n) for p in patterns)}
    assert {r.name for r in rules.pattern_semi_anti(df, "name", table, constants=0).collect()} == hit
    assert {r.name for r in rules.pattern_semi_anti(df, "name", None, table, constants=0).collect()} == set(names) - hit
    few = rules.pattern_semi_anti(df, "name", table, constants=len(patterns) - 1)
    assert {r.name for r in few.collect()} == hit
    assert "NestedLoop" not in few._jdf.queryExecution().toString() and "Cartesian" not in few._jdf.queryExecution().toString()


def test_snapshot_changes_of_long_texts_take_seconds(spark):
    a = "\n".join(f"line {i}" for i in range(100_000))
    b = "\n".join(f"line {i}" for i in range(1, 100_001))
    start = time.time()
    rows = spark.createDataFrame([(a, b)], "old string, new string").select(F.inline(V.snapshot_changes(F.col("old"), F.col("new")))).collect()
    assert {(r.sign, r.line) for r in rows} == {("-", "line 0"), ("+", "line 100000")} and time.time() - start < 60


def test_line_tables_compose(spark):
    docs = spark.createDataFrame([(1, "a\na\nb"), (2, "c")], "id int, text string")
    lines = L.explode_lines(docs, keep=["id"]).withColumn("chunk", L.line_chunk(F.col("at"), 2))
    rows = L.dedup_consecutive(lines, ["id"], "chunk", ["at"]).orderBy("id", "at").collect()
    assert [(r.id, r.at, r.line, r.n) for r in rows] == [(1, 1, "a  (x2)", 2), (1, 3, "b", 1), (2, 1, "c", 1)]


def test_null_lines_do_not_depend_on_the_chunks(spark):
    rows = [(1, i, x) for i, x in enumerate([None, None, None, "a", None])]
    df = spark.createDataFrame(rows, "s int, at int, line string")
    for size in (1, 2, 3, 10):
        out = L.islands(df.withColumn("chunk", F.floor(F.col("at") / size)), ["s"], "chunk", ["at"]).orderBy("at").collect()
        assert [(r.line, r.n) for r in out] == [(None, 3), ("a", 1), (None, 1)]


def test_null_keys_fail_loudly(spark):
    df = spark.createDataFrame([(None, 0, 1, "a")], "s string, chunk int, n int, line string")
    with pytest.raises(Exception, match="null in key column s"):
        L.number_lines(df, ["s"], "chunk", ["n"], "pos").collect()
    with pytest.raises(Exception, match="null in key column s"):
        L.head_tail(df, ["s"], ["n"]).collect()


CACHE_RUNS = "cmd_key string, capture_id bigint, t bigint, hash string, text string"


def cached(spark, tmp_path, batches, name, **options):
    """Answers of the stream cache, one file a batch; a last run of another key lets the watermark pass all others."""
    source = str(tmp_path / name)
    for k, rows in enumerate([*batches, [("end", 0, 10**7, "x", "")]]):
        spark.createDataFrame(rows, CACHE_RUNS).coalesce(1).write.mode("append").parquet(source)
        for f in glob.glob(f"{source}/*.parquet"):
            if os.stat(f).st_mtime > 10**9 + 1000:  # a new one
                os.utime(f, (10**9 + k, 10**9 + k))
    stream = spark.readStream.schema(CACHE_RUNS).option("maxFilesPerTrigger", 1).parquet(source)
    out, checkpoint = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint")
    job = stream_session_cache(stream, **options)
    query = job.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= len(batches)
    rows = spark.read.parquet(out).where("cmd_key <> 'end'").collect()
    got = {r.capture_id: (r.status, r.age, r.diff) for r in rows}
    assert len(got) == len(rows)
    return got


def test_stream_cache_in_any_batches(spark, tmp_path):
    """One batch, five batches in order, five at random: always the answers of session_fold."""
    rng = random.Random(5)
    runs, t = [], {"hot": 0, "b": 0, "c": 0}
    for i in range(240):
        key = "hot" if i % 3 else rng.choice("bc")
        t[key] += rng.choice([0, 1, 50, 400, 2500])
        runs.append((key, i, t[key], text := rng.choice(["a\nb\nc", "a\nb\nd", "x"]), text))
    batch = spark.createDataFrame([(*r, r[2] // 500) for r in runs], CACHE_RUNS + ", day bigint")
    want = {r.capture_id: (r.status, r.age) for r in V.session_fold(batch, ["cmd_key"], ["t", "capture_id"], ttl=1800).collect()}
    mixed = rng.sample(runs, len(runs))
    for name, batches in (("one", [mixed]), ("order", [runs[i:i + 48] for i in range(0, 240, 48)]), ("mixed", [mixed[i::5] for i in range(5)])):
        got = cached(spark, tmp_path, batches, name, ttl=1800, delay="100 hours", text="text")
        assert {k: v[:2] for k, v in got.items()} == want
        by_id = {r[1]: r for r in runs}
        for i, (status, age, diff) in got.items():
            if status == "changed":
                old = max((r for r in runs if r[0] == by_id[i][0] and r[2] == by_id[i][2] - age and got[r[1]][0] != "unchanged" and r[1] < i), key=lambda r: r[1])
                assert diff == changed_lines(old[4], by_id[i][4]) and diff
            else:
                assert diff is None


def test_stream_cache_over_batches(spark, tmp_path):
    """State lives over batches; a run that comes later but within the delay takes its place in time."""
    batches = [[("k", 1, 1000, "a", None), ("k", 2, 1100, "a", None)], [("k", 3, 1200, "b", None), ("k", 5, 900, "a", None)], [("k", 4, 9000, "b", None), ("k", 6, 9100, "b", None)]]
    got = cached(spark, tmp_path, batches, "runs", ttl=1800, delay="1 hour")
    assert got == {5: ("new", None, None), 1: ("unchanged", 100, None), 2: ("unchanged", 200, None), 3: ("changed", 300, None), 4: ("new", None, None), 6: ("unchanged", 100, None)}
    late = cached(spark, tmp_path, [[("k", 1, 100_000, "a", None)], [("k", 3, 100_001, "a", None)], [("k", 2, 5, "a", None)]], "late", ttl=1800, delay="1 minute")
    assert set(late) == {1, 3}  # beyond the delay


def test_changed_lines_are_those_of_the_batch(spark):
    pairs = [("a\nb", "a\nc\nc"), ("a", "a"), ("x\n" * 9, "y\n" * 9), ("b\na", "a\nb"), ("l" * 900, "m" * 900), (None, "a")]
    rows = V.snapshot_diff(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, old string, new string")).orderBy("i").collect()
    assert [r.diff for r in rows] == [changed_lines(*p) for p in pairs]
