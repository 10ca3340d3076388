"""Outcomes of test, build, install and version-control runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T
from loomsift.functions.text import let


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _found(text: Column, pattern: str) -> Column:
    """First match of group 1, null when there is none."""
    return _nonempty(F.regexp_extract(text, pattern, 1))


def error_text(text: Column) -> Column:
    """Error lines with one neighbour on each side, null without any."""
    return _nonempty(T.join_lines(A.error_lines(T.split_lines(text), 1)))


def build_errors(text: Column) -> Column:
    """``[ERROR]`` lines, repeats collapsed, 20 at most; null without any."""
    def render(lines: Column) -> Column:
        return F.when(F.size(lines) > 0, T.join_lines(
            A.head_tail(A.dedup_consecutive(lines), P.BUILD_ERROR_LINES)))
    return let(F.filter(T.split_lines(text), lambda x: F.startswith(x, F.lit("[ERROR]"))), render)


def good_outcome(kind: Column, text: Column) -> Column:
    """One line for a run that ended well."""
    tested = F.btrim(_found(text, P.TEST_SUMMARY), F.lit(" =\t-"))
    ok = T.strip(_found(text, P.BUILD_OK))
    time = T.strip(_found(text, P.BUILD_TIME))
    last = F.element_at(F.filter(T.split_lines(text), lambda x: T.strip(x) != ""), -1)
    built = F.coalesce(
        F.concat(F.lit("ok -- "), ok, F.coalesce(F.concat(F.lit("  ("), time, F.lit(")")), F.lit(""))),
        F.concat(F.lit("ok -- "), F.substring(F.when(T.strip(text) != "", last), 1, 120)), F.lit("ok"))
    return (F.when(kind == "test", F.coalesce(
                F.concat(F.lit("PASSED  ("), _nonempty(tested), F.lit(")")), F.lit("PASSED")))
            .when(kind == "build", built)
            .when(kind == "install", F.concat(F.lit("ok"), F.coalesce(
                F.concat(F.lit(" -- "), _found(text, P.INSTALL_OK)), F.lit(""))))
            .when(kind == "pull", F.concat(F.lit("ok"), F.coalesce(
                F.concat(F.lit(" "), _found(text, P.PULL_SUMMARY)), F.lit(""))))
            .otherwise(F.lit("valid")))


def bad_outcome(kind: Column, text: Column, code: Column, errors: Column) -> Column:
    """Errors of a run that failed, else its head and tail."""
    limit = F.when(kind == "test", P.SHORT_LINES).when(kind == "install", P.BUILD_ERROR_LINES) \
        .otherwise(P.FALLBACK_LINES)
    head = F.when(kind == "test", F.concat(F.lit("FAILED (exit "), code.cast("string"), F.lit(")\n"))) \
        .when(kind.isin("build", "install"), F.lit("FAILED\n")).otherwise(F.lit(""))
    body = F.coalesce(F.when(kind == "build", build_errors(text)), errors,
                      T.join_lines(A.head_tail(T.split_lines(text), limit)))
    return F.when(kind == "pull", text).otherwise(F.concat(head, body))


OUTCOME_KINDS = ("test", "build", "install", "pull", "validate")


def outcome(kind: Column, text: Column, code: Column, errors: Column) -> Column:
    """Outcome of a run whose progress lines are already gone."""
    return F.when(code == 0, good_outcome(kind, text)).otherwise(bad_outcome(kind, text, code, errors))


def run_outcome(runs: DataFrame, kind: str = "kind", text: str = "raw", code: str = "code") -> DataFrame:
    """Add ``outcome``: a one-line summary of good runs, the errors of bad ones."""
    body = T.join_lines(A.drop_progress(T.split_lines(F.col(text))))
    out = let(body, lambda t: outcome(F.col(kind), t, F.col(code), F.when(F.col(code) != 0, error_text(t))))
    return runs.withColumn("outcome", F.when(F.col(kind).isin(*OUTCOME_KINDS), out).otherwise(F.col(text)))


def pass_rate(runs: DataFrame, by: Sequence[str], code: str = "code") -> DataFrame:
    good = F.count_if(F.col(code) == 0)
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), good.alias("passed"),
                                 F.round(good * 100.0 / F.count("*"), 2).alias("pass_pct"))


# --- test reports ------------------------------------------------------------

def test_report(text: Column) -> Column:
    """(summary, shorts, blocks) of a test log.

    ``shorts`` are the ``FAILED`` / ``ERROR`` summary lines, ``blocks`` the
    failing tests with at most six assertion or location lines.
    """
    def is_short(x: Column) -> Column:
        s = T.strip(x)
        return (F.contains(x, F.lit("FAILED ")) | F.contains(x, F.lit("ERROR "))) & (F.startswith(s, F.lit("FAILED ")) | F.startswith(s, F.lit("ERROR ")))

    def is_section(x: Column) -> Column:
        # Byte searches settle most lines, here and below.
        return F.contains(x, F.lit("=")) & let(T.strip(x), lambda s: F.startswith(s, F.lit("=")) & s.rlike(P.TEST_SECTION))

    def section_name(head: Column) -> Column:
        return F.regexp_extract(T.strip(head), P.TEST_SECTION, 1)

    def is_block(x: Column) -> Column:
        return F.contains(x, F.lit("___")) & T.strip(x).rlike(P.TEST_BLOCK)

    def is_detail(x: Column) -> Column:
        return (F.startswith(x, F.lit("E ")) | F.startswith(x, F.lit("E\t"))
                | (F.contains(x, F.lit(":")) & T.strip(x).rlike(P.TEST_LOCATION)))

    def build(lines: Column) -> Column:
        def from_sections(secs: Column) -> Column:
            named = F.filter(F.transform(secs, lambda s: F.struct(section_name(F.coalesce(s["head"], F.lit(""))).alias("name"), s["body"].alias("body"))),
                             lambda s: s["name"] != "")
            return let(named, from_named)

        def from_named(named: Column) -> Column:
            ended = F.transform(F.filter(named, lambda s: F.contains(s["name"], F.lit(" in ")) & s["name"].rlike("(?i)(failed|passed|error|skipped)")),
                                lambda s: s["name"])
            plain = F.filter(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(" in "))), lambda x: T.strip(x)),
                             lambda s: s.rlike(r"^\d+\s+(failed|passed|error)") & F.contains(s, F.lit(" in ")))
            summary = F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), ended), -1),
                                 F.element_at(F.concat(F.array(F.lit(None).cast("string")), plain), -1), F.lit(""))
            shorts = F.transform(F.filter(lines, lambda x: is_short(x) & ~is_section(x)),
                                 lambda x: T.clip_line(T.strip(x)))
            failing = F.filter(named, lambda s: s["name"].isin("FAILURES", "ERRORS"))
            blocks = F.flatten(F.transform(failing, lambda s: F.filter(
                A.segments(F.filter(s["body"], lambda x: ~is_short(x)), is_block),
                lambda b: b["head"].isNotNull())))
            details = F.transform(blocks, lambda b: F.struct(
                F.regexp_extract(T.strip(b["head"]), P.TEST_BLOCK, 1).alias("name"),
                F.transform(F.slice(F.filter(b["body"], is_detail), 1, 6), lambda x: T.strip(x)).alias("details")))
            return F.struct(summary.alias("summary"), shorts.alias("shorts"), details.alias("blocks"))
        return let(A.segments(lines, is_section), from_sections)
    return let(T.split_lines(text), build)


def _base_name(name: Column) -> Column:
    """Last dotted part of a test name without its parameters."""
    return F.substring_index(F.substring_index(name, "[", 1), ".", -1)


def _short_name(line: Column) -> Column:
    test = F.substring_index(F.regexp_replace(line, r"^(FAILED|ERROR) ", ""), " - ", 1)
    return _base_name(F.substring_index(test, "::", -1))


def _full_name(line: Column) -> Column:
    """Test name of a summary line with its parameters."""
    name = F.substring_index(F.regexp_replace(line, r"^(FAILED|ERROR) ", ""), " - ", 1)
    return F.concat(_short_name(line), F.regexp_extract(name, r"(\[.*\])$", 1))


def test_failures(runs: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    """One row per failing test of every run: summary line and details.

    Summary lines and blocks meet on the test name, the k-th line of a name
    with its k-th block; either side may be missing.  They stand in one row, so they
    meet there, without an exchange.
    """
    empty = F.lit(None).cast("string")

    def build(r: Column) -> Column:
        entries = F.concat(
            F.transform(r["shorts"], lambda x, i: F.struct(
                _short_name(x).alias("k"), i.alias("at"), x.alias("short"), empty.alias("details"))),
            F.transform(r["blocks"], lambda b, i: F.struct(
                _base_name(b["name"]).alias("k"), i.alias("at"), empty.alias("short"), T.join_lines(b["details"]).alias("details"))))

        def paired(g: Column) -> Column:
            shorts, blocks = (F.filter(g["members"], lambda m: m[side].isNotNull()) for side in ("short", "details"))
            pairs = let(shorts, lambda s: let(blocks, lambda b: F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(s), F.size(b)) - 1),
                lambda i: F.struct((i + 1).cast("bigint").alias("occurrence"), F.get(s, i)["short"].alias("short"), F.get(b, i)["details"].alias("details")))))
            return F.transform(pairs, lambda p: F.struct(g["k"].alias("test"), p["occurrence"].alias("occurrence"), p["short"].alias("short"), p["details"].alias("details")))
        return F.flatten(F.transform(A.grouped(entries), paired))
    return runs.select(*keys, F.inline(let(test_report(F.col(text)), build)))


def flaky_tests(failures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failures per test over the whole corpus."""
    return failures.groupBy("test").agg(F.count("*").alias("failures"),
                                        F.count_if(F.col("details").isNotNull()).alias("with_details"))


def compact_test(text: Column, code: Column, errors: Column | None = None) -> Column:
    """One line for a good run; summary, failing tests and details otherwise.

    Null when the text of a failing run has no test report in it.
    """
    none = F.array().cast("array<string>")

    def indented(details: Column) -> Column:
        return F.coalesce(F.transform(details, lambda d: F.concat(F.lit("  "), d)), none)

    def render(r: Column) -> Column:
        # A summary line takes the block of its full name with parameters, else that of
        # its base name; the k-th line of a name takes the k-th block.
        names = F.struct(
            F.transform(r["shorts"], lambda x: F.struct(_full_name(x).alias("full"), _short_name(x).alias("base"))).alias("s"),
            F.transform(r["blocks"], lambda b: F.struct(F.substring_index(F.substring_index(b["name"], "[", 1), ".", -1).alias("base"), F.concat(
                _base_name(b["name"]), F.substring(b["name"], F.length(F.substring_index(b["name"], "[", 1)) + 1, F.length(b["name"]))).alias("full"))).alias("b"))

        def with_names(n: Column) -> Column:
            def nth(rows: Column, i: Column, field: str, want: Column) -> Column:
                """How many of the first ``i`` rows have this name."""
                return F.size(F.filter(F.slice(rows, F.lit(1), i), lambda x: x[field] == want))

            def block_of(i: Column) -> Column:
                s = F.get(n["s"], i)

                def by(field: str) -> Column:
                    hits = F.filter(F.transform(n["b"], lambda x, j: F.struct(x[field].alias("name"), j.alias("j"))), lambda x: x["name"] == s[field])
                    return F.get(hits, nth(n["s"], i, field, s[field]))["j"]
                return F.coalesce(by("full"), F.when(~F.exists(n["b"], lambda x: x["full"] == s["full"]), by("base")))

            def with_blocks(at: Column) -> Column:
                shown = F.slice(r["shorts"], 1, 15)
                lines = F.flatten(F.transform(shown, lambda x, i: F.concat(F.array(x), indented(F.get(r["blocks"], F.get(at, i))["details"]))))
                lone = F.filter(F.transform(r["blocks"], lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda x: ~F.exists(at, lambda a: a.eqNullSafe(x["j"])))

                def with_lone(rest: Column) -> Column:
                    tail = F.flatten(F.transform(F.slice(rest, 1, 15), lambda x: F.concat(
                        F.array(F.concat(F.lit("FAILED "), x["b"]["name"])), indented(x["b"]["details"]))))
                    more = F.greatest(F.size(r["shorts"]) - 15, F.lit(0)) + F.greatest(F.size(rest) - 15, F.lit(0))
                    parts = F.concat(F.filter(F.array(r["summary"]), lambda s: s != ""), lines, tail, F.when(
                        more > 0, F.array(F.concat(F.lit("...(+"), more.cast("string"), F.lit(" more failures)")))).otherwise(none))
                    return F.when(F.size(parts) > 0, T.join_lines(parts))
                return let(lone, with_lone)
            return let(F.transform(n["s"], lambda _, i: block_of(i)), with_blocks)
        return let(names, with_names)

    passed = T.strip(_found(text, P.TEST_PASSED))
    good = F.coalesce(F.concat(F.lit("PASSED  ("), passed, F.lit(")")), F.lit("PASSED"))
    bad = F.concat(F.lit("FAILED (exit "), code.cast("string"), F.lit(")\n"), F.coalesce(
        let(test_report(text), render), errors if errors is not None else error_text(text),
        T.join_lines(A.head_tail(T.split_lines(text), P.SHORT_LINES))))
    return F.when(code == 0, good).otherwise(bad)
