"""The whole pipeline over a table of captured command outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T
from loomsift.functions.text import let
from loomsift.operators import findings, jsonops, profiles, runs
from loomsift.operators.files import is_code
from loomsift.operators.versions import session_fold, snapshot_changes
from loomsift.plans import rules, shapes
from loomsift.sources.writers import tee_policy, tee_slug


def compact_search(text: Column) -> Column:
    """Search output grouped by file."""
    lines = F.filter(T.split_lines(text), lambda x: x != "")
    hits = F.filter(F.transform(lines, lambda x, i: F.struct(
        F.regexp_extract(x, P.GREP_HIT, 1).alias("k"), i.alias("at"),
        F.concat(F.regexp_extract(x, P.GREP_HIT, 2), F.lit(": "),
                 F.substring(T.strip(F.regexp_extract(x, P.GREP_HIT, 3)), 1, 160)).alias("show"))),
        lambda h: h["k"] != "")
    return let(hits, lambda h: F.coalesce(
        A.grouped_lines(h, "matches", P.HITS_PER_FILE, 2147483647, F.size(h)),
        T.join_lines(A.head_tail(A.dedup_consecutive(lines)))))


def compact_lint(text: Column, code: Column) -> Column:
    """Lint output grouped by file; ``clean`` when a good run has no issue."""
    def hit(x: Column, i: Column) -> Column:
        def parse(s: Column) -> Column:
            f = F.regexp_extract(s, P.LINT_HIT, 1)
            full = (f != "") & ~F.startswith(f, F.lit("-"))
            short = F.regexp_extract(s, P.LINT_HIT_NO_COLUMN, 1)
            return F.struct(
                F.when(full, f).otherwise(short).alias("k"), i.alias("at"),
                F.when(full, F.concat(F.regexp_extract(s, P.LINT_HIT, 2), F.lit(":"),
                                      F.regexp_extract(s, P.LINT_HIT, 3), F.lit(" "),
                                      F.substring(F.regexp_extract(s, P.LINT_HIT, 4), 1, 140)))
                .otherwise(F.concat(F.regexp_extract(s, P.LINT_HIT_NO_COLUMN, 2), F.lit(" "),
                                    F.substring(F.regexp_extract(s, P.LINT_HIT_NO_COLUMN, 3), 1, 140)))
                .alias("show"))
        return let(T.strip(x), parse)
    lines = T.split_lines(text)
    return let(F.filter(F.transform(lines, hit), lambda h: h["k"] != ""), lambda h: F.coalesce(
        A.grouped_lines(h, "issue(s)", P.LINT_HITS_PER_FILE, P.LINT_FILES, F.size(h)),
        F.when(code == 0, F.lit("clean")).otherwise(T.join_lines(A.head_tail(lines, P.FALLBACK_LINES)))))


def compact_paths(text: Column) -> Column:
    """Path list: count, most frequent extensions, first 25 paths."""
    def render(lines: Column) -> Column:
        exts = A.grouped(F.transform(lines, lambda x, i: F.struct(T.path_ext(x).alias("k"), i.alias("at"))))
        top = F.slice(F.sort_array(F.transform(exts, lambda g: F.struct(
            (-F.size(g["members"])).alias("n"), g["at"].alias("at"), g["k"].alias("k")))), 1, 8)
        kinds = F.array_join(F.transform(top, lambda g: F.concat(g["k"], F.lit("="), (-g["n"]).cast("string"))), ", ")
        shown = F.slice(lines, 1, 25)
        more = F.size(lines) - 25
        none = F.array().cast("array<string>")
        return let(A.fold_prefix(shown), lambda pre: T.join_lines(F.concat(
            F.array(F.concat(F.size(lines).cast("string"), F.lit(" results"))),
            F.when(F.size(lines) > 0, F.array(F.concat(F.lit("by type: "), kinds))).otherwise(none),
            F.when(pre != "", F.array(F.concat(F.lit("in "), pre))).otherwise(none),
            F.transform(shown, lambda x: F.substring(x, F.length(pre) + 1, F.lit(2147483647))),
            F.when(more > 0, F.array(F.concat(F.lit("...(+"), more.cast("string"), F.lit(" more)")))).otherwise(none))))
    return let(F.filter(T.split_lines(text), lambda x: x != ""), render)


def compact_listing(text: Column) -> Column:
    """Long directory listing: counts, directories, first 20 files."""
    def render(lines: Column) -> Column:
        rows = F.filter(lines, lambda x: x.rlike(r"^[d-][rwxsStT-]{9}"))
        names = F.transform(rows, lambda x: F.struct(
            F.startswith(x, F.lit("d")).alias("is_dir"),
            F.regexp_extract(x, r"^(?:\S+\s+){8}(.*)$", 1).alias("name")))
        seen = F.filter(names, lambda e: (e["name"] != "") & ~F.startswith(e["name"], F.lit(".")))

        def build(e: Column) -> Column:
            dirs = F.filter(e, lambda x: x["is_dir"])
            files = F.filter(e, lambda x: ~x["is_dir"])
            more = F.size(files) - 20
            none = F.array().cast("array<string>")
            return T.join_lines(F.concat(
                F.array(F.concat(F.lit("["), F.size(dirs).cast("string"), F.lit(" dirs, "),
                                 F.size(files).cast("string"), F.lit(" files]"))),
                F.transform(dirs, lambda d: F.concat(F.lit("  "), d["name"], F.lit("/"))),
                F.when(F.size(files) > 0, F.array(F.concat(F.lit("  "), F.array_join(
                    F.transform(F.slice(files, 1, 20), lambda f: f["name"]), "  ")))).otherwise(none),
                F.when(more > 0, F.array(F.concat(F.lit("  ...(+"), more.cast("string"), F.lit(" more files)"))))
                .otherwise(none)))
        return F.when(F.size(rows) > 0, let(seen, build)).otherwise(
            T.join_lines(A.head_tail(A.dedup_consecutive(lines))))
    return let(T.split_lines(text), render)


def compact_plan_json(text: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Planned changes of a JSON plan; null when the text is not one.

    Only resources whose address matches any ``include`` and no ``exclude`` pattern count.
    """
    def render(changes: Column) -> Column:
        def actions(c: Column) -> Column:
            return F.array_join(F.coalesce(c["change"]["actions"], F.array().cast("array<string>")), ",")
        real = F.filter(changes, lambda c: ~actions(c).isin("", "no-op", "read")
                        & jsonops.allowed(F.coalesce(c["address"], F.lit("?")), include, exclude))

        def attrs(c: Column) -> Column:
            none = F.create_map().cast("map<string,string>")
            before = F.coalesce(c["change"]["before"], none)
            diff = F.filter(F.map_entries(F.coalesce(c["change"]["after"], none)),
                            lambda e: ~e["value"].eqNullSafe(F.try_element_at(before, e["key"])))

            def show(d: Column) -> Column:
                more = F.size(d) - P.ATTRS_SHOWN
                line = lambda e: F.when(T.is_secret_key(e["key"]), F.concat(F.lit("    "), e["key"], F.lit(": " + P.MASK))) \
                    .otherwise(F.concat(F.lit("    "), e["key"], F.lit(": "), jsonops.short_value(F.coalesce(
                        F.try_element_at(before, e["key"]), F.lit("None"))), F.lit("->"),
                        jsonops.short_value(F.coalesce(e["value"], F.lit("None")))))
                return F.concat(F.transform(F.slice(d, 1, P.ATTRS_SHOWN), line), F.when(
                    more > 0, F.array(F.concat(F.lit("    (+"), more.cast("string"), F.lit(" more attrs)"))))
                    .otherwise(F.array().cast("array<string>")))
            return let(diff, show)

        def one(c: Column) -> Column:
            addr = F.coalesce(c["address"], F.lit("?"))
            a = actions(c)
            after = F.coalesce(c["change"]["after"], F.create_map().cast("map<string,string>"))
            name = F.coalesce(F.try_element_at(after, F.lit("name")), F.try_element_at(after, F.lit("id")), F.lit(""))
            return (F.when(a.isin("create,delete", "delete,create"), F.concat(
                        F.array(F.concat(F.lit("-/+ "), addr, F.lit(" (replace)"))), attrs(c)))
                    .when(a == "update", F.concat(F.array(F.concat(F.lit("~ "), addr)), attrs(c)))
                    .when(a == "create", F.array(F.rtrim(F.concat(F.lit("+ "), addr, F.lit(" "), jsonops.short_value(name)))))
                    .when(a == "delete", F.array(F.concat(F.lit("- "), addr)))
                    .otherwise(F.array(F.concat(F.replace(a, F.lit(","), F.lit("/")), F.lit(" "), addr))))

        def count(match) -> Column:
            return lambda cs: F.size(F.filter(cs, match)).cast("string")
        adds = count(lambda c: F.coalesce(F.array_contains(c["change"]["actions"], "create"), F.lit(False)))
        gone = count(lambda c: F.coalesce(F.array_contains(c["change"]["actions"], "delete"), F.lit(False)))
        upd = count(lambda c: actions(c) == "update")
        return let(real, lambda cs: T.join_lines(F.concat(
            F.array(F.concat(F.lit("Plan: "), adds(cs), F.lit(" add, "), upd(cs), F.lit(" change, "), gone(cs),
                             F.lit(" destroy"))),
            F.when(F.size(cs) > 0, F.flatten(F.transform(cs, one))).otherwise(F.array(F.lit("No resource changes."))))))
    plan = F.from_json(T.strip(text), jsonops.PLAN_SCHEMA)["resource_changes"]
    return F.when(plan.isNotNull(), let(plan, render))


# How plain treatments differ: (drop progress lines, repeats, lines kept).
PLAIN = {
    "log": (True, "smart", P.LOG_LINES), "journal": (False, "smart", P.LOG_LINES),
    "container_log": (True, "smart", P.TABLE_LINES), "auto_text": (True, "smart", P.MAX_LINES),
    "generic": (True, "runs", P.MAX_LINES), "generic_table": (True, "runs", P.TABLE_LINES),
    "generic_train": (True, "runs", P.RESPONSE_LINES), "generic_raw": (False, "runs", P.MAX_LINES),
    "cut_long": (False, "none", P.MAX_LINES), "cut_mid": (False, "none", P.RESPONSE_LINES),
    "cut_short": (False, "none", P.SHORT_LINES),
}


def compact_plain(action: Column, text: Column) -> Column:
    """Clean, collapse and cut a text as its action says, in one expression."""
    def pick(part: int, keep) -> list[str]:
        return [name for name, row in PLAIN.items() if keep(row[part])]

    def repeats(lines: Column) -> Column:
        return (F.when(action.isin(*pick(1, lambda m: m == "smart")), A.smart_dedup(lines))
                .when(action.isin(*pick(1, lambda m: m == "runs")), A.dedup_consecutive(lines))
                .otherwise(lines))

    limit = F.lit(P.MAX_LINES)
    for n in sorted({row[2] for row in PLAIN.values()}):
        limit = F.when(action.isin(*pick(2, lambda x, n=n: x == n)), n).otherwise(limit)
    stripped = let(T.split_lines(T.clean_control(text)), lambda lines: F.when(
        action.isin(*pick(0, bool)), A.drop_progress(lines)).otherwise(lines))
    return T.join_lines(A.head_tail(let(stripped, repeats), limit))


def action_of(rule: Column, argv: Column, code: Column, text: Column) -> Column:
    """What to do with a capture: rule, sub-command and shape in one word."""
    sub = F.coalesce(F.get(argv, F.lit(1)), F.lit(""))
    pods = F.arrays_overlap(argv, F.array(F.lit("pods"), F.lit("po"), F.lit("pod"))) & (sub == "get")
    tabular = sub.isin("get", "ps", "images", "image", "ls", "list", "services", "pods", "top")
    shape = shapes.classify_shape(text)
    git = (F.when(sub.isin("status", "diff", "show", "pull", "commit", "push"), F.concat(F.lit("git_"), sub))
           .when(sub.isin("add", "stage"), "git_add").when(sub == "log", "cut_long")
           .when(sub.isin("branch", "remote", "tag"), "cut_mid").when(sub == "stash", "cut_short")
           .otherwise("generic_raw"))
    container = (F.when(F.array_contains(argv, "logs"), "container_log").when(sub == "describe", "describe")
                 .when(pods, "pods").when(tabular, "table").otherwise("generic_table"))
    plan = (F.when(F.array_contains(argv, "-json"), "plan_json").when(sub.isin("plan", "apply"), "plan_text")
            .when(sub == "validate", "validate").when(sub.isin("output", "state", "show", "providers"), "generic_table")
            .otherwise("generic"))
    auto = let(shape, lambda s: F.when(s == "diff", "git_diff").when(s.isin("binary", "trace", "empty"), s)
               .when(s == "training", "train_auto").otherwise("auto_text"))
    signatures = (sub == "aggressive") & is_code(F.element_at(argv, -1))
    return (F.when(rule == "git", git).when(rule == "container", container).when(rule == "plan", plan)
            .when(rule == "auto", auto)
            .when(rule == "cloud", F.when(findings.looks_tabular(text), "table").otherwise("generic"))
            .when(rule == "units", F.when(sub == "status", "status_fields").otherwise("table"))
            .when(rule == "package", F.when(sub.isin("install", "i", "add", "ci"), "install").otherwise("generic"))
            .when(rule == "file", F.when(signatures, "signatures").otherwise("same"))
            .when(rule.isin("", "measure", "json"), "same")
            .otherwise(rule))


WRAPPED = ("container", "plan", "cloud", "journal", "units", "train")


CLEANED = ("test", "test_report", "build", "package", "plan")


def compact_by_rule(rule: Column, argv: Column, code: Column, text: Column,
                    include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Compact text of one capture for every rule.

    Every treatment occurs once; the action picks one of them per row.
    """
    lines = T.split_lines(text)
    none = F.array().cast("array<string>")

    def body(act: Column, errors: Column) -> Column:
        label = F.array_join(F.slice(argv, 1, 2), " ")
        drop = (F.when(label == "docker ps", F.array(*[F.lit(c) for c in ("CONTAINER ID", "COMMAND", "PORTS")]))
                .when(label == "docker images", F.array(F.lit("IMAGE ID")))
                .when(F.array_contains(argv, "wide"), F.array(*[
                    F.lit(c) for c in ("IP", "NODE", "NOMINATED NODE", "READINESS GATES")])).otherwise(none))
        kind = F.when(act == "git_pull", "pull").otherwise(act)
        cleaned = T.join_lines(A.drop_progress(lines))
        sha = F.regexp_extract(text, r"\[[^\]]*?([0-9a-f]{7,40})\]", 1)
        branch = F.regexp_extract(text, r"-> (\S+)", 1)
        good = (F.when(act == "git_commit", F.rtrim(F.concat(F.lit("ok "), sha)))
                .when(act == "git_push", F.rtrim(F.concat(F.lit("ok "), branch))).otherwise(F.lit("ok")))
        bad = F.when(act == "git_commit", F.coalesce(
            F.nullif(T.join_lines(A.error_lines(lines)), F.lit("")), text)).otherwise(text)
        curve = profiles.compact_training(text)
        shown = T.clean_control(text)
        table = findings.compact_table(shown, drop)
        cases = [
            (("same",), text), (("empty",), F.lit("")),
            (("git_diff",), findings.compact_diff(text)), (("git_status",), findings.compact_status(text)),
            (("git_show",), findings.compact_show(text)),
            (("git_commit", "git_push", "git_add"), F.when(code == 0, good).otherwise(bad)),
            (("test", "build", "install", "git_pull", "validate", "test_report"),
             let(cleaned, lambda t: F.when(act == "test_report", runs.compact_test(t, code, errors))
                 .otherwise(runs.outcome(kind, t, code, errors)))),
            (("errors",), F.coalesce(errors, F.lit("(no error lines detected)"))),
            (("describe",), shapes.describe_fields(shown)), (("status_fields",), shapes.status_fields(shown)),
            (("plan_text",), shapes.plan_text_lines(text)), (("trace",), shapes.compact_trace(text)),
            (("binary",), shapes.binary_note(text)), (("response",), shapes.compact_response(text)),
            (("lint",), compact_lint(text, code)), (("search",), compact_search(text)),
            (("paths",), compact_paths(text)), (("listing",), compact_listing(text)),
            (("signatures",), T.join_lines(F.filter(lines, T.is_signature))),
        ]
        special = F.when(act.isin("train", "train_auto"), curve).when(act == "pods", findings.compact_pods(shown))
        fallback = F.when(act.isin("pods", "table"), table).otherwise(compact_plain(
            F.when(act == "train", "generic_train").when(act == "train_auto", "auto_text")
            .when(act == "plan_json", "generic_table").otherwise(act), text))
        out = F.coalesce(special, fallback)
        for names, c in reversed(cases):
            out = F.when(act.isin(*names), c).otherwise(out)
        # A failing run shows its errors; a plan read as JSON shows the plan.
        wrapped = rule.isin(*WRAPPED) & (act != "validate") & (code != 0)
        return F.coalesce(F.when(act == "plan_json", compact_plan_json(text, include, exclude)), F.when(wrapped, errors), out)

    # Test and build runs are cleaned of progress lines before their errors are read.
    source = F.when(rule.isin(*CLEANED), T.join_lines(A.drop_progress(lines))).otherwise(text)
    errors = F.when((code != 0) | (rule == "errors"), runs.error_text(source))
    return F.when(rule.isin("", "measure"), text).otherwise(
        let(errors, lambda e: let(action_of(rule, argv, code, text), lambda a: body(a, e))))


TWO_WORD_LABELS = ("git", "container", "package", "plan", "units", "errors", "measure")


def label_of(rule: Column, argv: Column, preset: Column) -> Column:
    """Ledger label: three words of a cloud preset, two of runners and multi-word tools, else one."""
    pair = F.array_join(F.slice(argv, 1, 2), " ")
    runner = pair.isin(*(f"{a} {b}" for a, b in rules.TWO_WORD_RULES))
    return F.when(preset, F.array_join(F.slice(argv, 1, 3), " ")) \
        .when(rule.isin(*TWO_WORD_LABELS) | ((rule == "test") & runner), pair) \
        .otherwise(F.coalesce(F.get(argv, F.lit(0)), F.lit("")))


def compact_captures(captures: DataFrame, rule_rows: DataFrame | None = None, budget: int = 0,
                     tee_mode: str = "failures", redact_all: bool = False,
                     exclude: Sequence[str] = (), session_cache: bool = False,
                     ttl: int = P.CACHE_TTL_SECONDS, resource_include: Sequence[str] = (),
                     resource_exclude: Sequence[str] = ()) -> DataFrame:
    """Rule, compaction, cache, size floor, tee and budget for every capture.

    Result: captures + ``rule``, ``label``, ``compact``, ``redacted``, ``tee``.
    A capture without a rule, or of an excluded command, passes as it is: no step
    touches its text, and nothing of it is kept.  Every text is compacted in its row;
    only repeated runs, with ``session_cache`` on, meet other rows.
    """
    c = rules.rule_lookup(captures, rule_rows, exclude=exclude)
    raw, argv, code, rule = F.col("raw"), F.col("argv"), F.col("code"), F.col("rule")
    mine = rule.isNotNull()
    json_like = F.coalesce(rule.isin("json", "cloud", "auto") & F.substring(T.strip(T.strip_bom(raw)), 1, 1).isin("{", "["), F.lit(False))
    json_text = F.when(json_like, raw)
    special = F.when((rule == "cloud") & json_like, jsonops.compact_cloud(rules.cloud_rule(argv), json_text, resource_include, resource_exclude))
    c = c.withColumn("_special", special).withColumn("_json", F.when(F.col("_special").isNull(), jsonops.compact_json(json_text)))
    c = c.withColumn("label", label_of(rule, argv, F.col("_special").isNotNull()))

    texts = F.col("_special").isNull() & F.col("_json").isNull()
    body = compact_by_rule(F.coalesce(rule, F.lit("")), argv, code, raw, resource_include, resource_exclude)
    c = c.withColumn("_body", F.when(texts, body))
    # A text that looks like JSON and is none is masked as text.
    mask = (rule == "auto") | json_like | (F.lit(redact_all) & mine)
    members = F.when(json_like, T.redact_members(F.col("_body"))).otherwise(F.col("_body"))
    masked = F.when(F.coalesce(mask, F.lit(False)), T.redact(members)).otherwise(F.col("_body"))
    by_key = F.coalesce((rule == "plan") & F.array_contains(argv, "-json") & (F.col("_body") != raw), F.lit(False))
    lines = T.join_lines(A.head_tail(T.split_lines(F.col("_json.compact")), P.JSON_LINES))
    out = c.withColumn("compact", F.coalesce("_special", lines, masked)) \
        .withColumn("redacted", F.coalesce(F.when(F.col("_special").isNotNull(), F.lit(True)), F.col("_json.redacted"),
                                           by_key | (F.col("compact") != F.col("_body")))).drop("_special", "_json", "_body")

    if session_cache:
        out = apply_session_cache(out, captures, ttl)
    out = out.withColumn("compact", F.when(mine, A.size_floor(raw, F.col("compact"), F.col("redacted"))).otherwise(raw))
    out = out.withColumn("tee", mine & tee_policy(tee_mode))
    note = F.concat(F.lit("\n[full output: "), tee_slug(argv), F.lit(".log]"))
    out = out.withColumn("compact", F.when(F.col("tee") & (code != 0), F.concat("compact", note))
                         .otherwise(F.col("compact")))
    return out.withColumn("compact", F.when(mine, A.budget(F.col("compact"), budget)).otherwise(F.col("compact")))


def apply_session_cache(results: DataFrame, captures: DataFrame, ttl: int = P.CACHE_TTL_SECONDS) -> DataFrame:
    """Shorten repeated good runs of the same command.

    ``unchanged`` becomes one line; ``changed`` shows the changed lines when that
    is shorter.  The state comes from hashes alone, in a prefix scan over ranges,
    so a command that runs all the time is spread over many tasks.  Texts are
    fetched only for changed runs.
    """
    rows = results.where((F.col("code") == 0) & F.col("rule").isNotNull()).select(
        "capture_id", F.sha1(F.encode(F.array_join("argv", " "), "utf-8")).alias("cmd_key"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        F.sha1(F.encode("raw", "utf-8")).alias("hash"))
    state = session_fold(rows, ["cmd_key"], ["t", "capture_id"], ttl=ttl, previous=["capture_id"]) \
        .select("capture_id", "status", "age", "prev_capture_id")
    texts = captures.select("capture_id", "raw")
    old = texts.select(F.col("capture_id").alias("prev_capture_id"), F.col("raw").alias("_old"))
    changed = state.where(F.col("status") == "changed").select("capture_id", "prev_capture_id") \
        .join(texts, "capture_id").join(old, "prev_capture_id")
    diffs = changed.withColumn("_c", snapshot_changes(F.col("_old"), F.col("raw"))) \
        .where(F.size("_c").between(1, P.CACHE_DIFF_LINES))
    lines = T.join_lines(F.transform("_c", lambda x: F.concat(x["sign"], T.clip_line(x["line"]))))
    diffs = diffs.select("capture_id", T.redact(lines).alias("_diff"))
    j = results.join(state.drop("prev_capture_id"), "capture_id", "left").join(diffs, "capture_id", "left")
    age = F.col("age").cast("string")
    same = F.concat(F.lit("(unchanged since "), age, F.lit("s ago)"))
    diff = F.when(~F.col("redacted"), F.concat(F.lit("(changed since "), age, F.lit("s ago)\n"), F.col("_diff")))
    note = F.when(F.col("status") == "unchanged", same) \
        .when(F.length(diff) < F.length("compact"), diff)
    return j.withColumn("_note", note).withColumns({
        "compact": F.coalesce("_note", "compact"),
        "redacted": F.col("redacted") | F.col("_note").isNotNull()}).drop("_note", "_diff", "status", "age")


def savings_report(ledger: DataFrame, price_per_1k: float = 0.0) -> DataFrame:
    """Runs and tokens by command, most saved first, then the total row (``cmd`` null)."""
    g = ledger.rollup("cmd").agg(F.count("*").alias("runs"), F.sum("raw").alias("raw"), F.sum("out").alias("out"))
    saved, pct = T.saved_columns(F.col("raw"), F.col("out"))
    out = g.withColumns({"saved": saved, "pct": pct}).orderBy(F.col("cmd").isNull(), F.desc("saved"), "cmd")
    if price_per_1k:
        out = out.withColumn("money", F.col("saved") * price_per_1k / 1000.0)
    return out
