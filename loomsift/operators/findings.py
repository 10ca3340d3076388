"""Findings: search hits, lint issues, paths, status codes, diffs, tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T
from loomsift.functions.text import let
from loomsift.operators.lines import top_k_per_group

# --- search hits -------------------------------------------------------------


def find_lines(files: DataFrame, pattern: str, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Matching lines of every file with their line numbers (from 1)."""
    hits = F.filter(F.transform(T.split_lines(F.col(text)), lambda x, i: F.struct(
        (i + 1).alias("line_no"), x.alias("line"))), lambda h: h["line"].rlike(pattern))
    # A text without any hit is settled before it is split, unless the pattern
    # can tell a line from the same line inside a text.
    if not re.search(r"\(\?<?[=!]|\\[AzZGB]", pattern):
        files = files.where(F.col(text).rlike(f"(?m){pattern}"))
    return files.select(*keys, F.inline(hits))


def group_matches(hits: DataFrame, file: str = "file", per_file: int = P.HITS_PER_FILE,
                  clip: int = 200) -> DataFrame:
    """Hits grouped by file: count per file next to its first ``per_file`` hits."""
    counts = hits.groupBy(file).agg(F.count("*").alias("hits"))
    first = top_k_per_group(hits, [file], ["line_no"], per_file)
    return first.join(counts, file).select(
        file, "hits", F.col("rank").cast("bigint").alias("rank"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.substring(T.strip(F.col("line")), 1, clip).alias("line"))


def count_matches(hits: DataFrame, file: str = "file") -> DataFrame:
    """Total matches and files with a match."""
    return hits.groupBy(file).agg(F.count("*").alias("n")) \
        .agg(F.sum("n").alias("matches"), F.count("*").alias("files"))


def parse_grep_output(runs: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    """``path:line:text`` lines as findings; other non-empty lines have no file."""
    lines = runs.select(*keys, F.posexplode(T.split_lines(F.col(text))).alias("pos", "l")) \
        .where(F.col("l") != "")
    hit = F.col("l").rlike(P.GREP_HIT)
    return lines.select(
        *keys, F.col("pos").cast("bigint").alias("pos"),
        F.when(hit, F.regexp_extract("l", P.GREP_HIT, 1)).alias("file"),
        F.when(hit, F.regexp_extract("l", P.GREP_HIT, 2).try_cast("bigint")).alias("line_no"),
        F.when(hit, F.substring(T.strip(F.regexp_extract("l", P.GREP_HIT, 3)), 1, 160))
        .otherwise(F.col("l")).alias("msg"))


def lint_findings(runs: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    """``path(line,col)`` / ``path:line:col`` / ``path:line`` issues of lint runs."""
    lines = runs.select(*keys, F.posexplode(T.split_lines(F.col(text))).alias("pos", "l")) \
        .withColumn("l", T.strip(F.col("l")))
    full = F.regexp_extract("l", P.LINT_HIT, 1)
    is_full = F.col("l").rlike(P.LINT_HIT) & (full != "") & ~F.startswith(full, F.lit("-"))
    is_short = ~is_full & F.col("l").rlike(P.LINT_HIT_NO_COLUMN)

    def part(i: int, j: int | None) -> Column:
        short = F.regexp_extract("l", P.LINT_HIT_NO_COLUMN, j) if j else F.lit(None)
        return F.when(is_full, F.regexp_extract("l", P.LINT_HIT, i)).when(is_short, short)

    return lines.where(is_full | is_short).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), part(1, 1).alias("file"),
        part(2, 2).try_cast("bigint").alias("line_no"), part(3, None).try_cast("bigint").alias("col_no"),
        F.substring(part(4, 3), 1, 140).alias("msg"))


def group_lint(findings: DataFrame, order: Sequence[str], per_file: int = P.LINT_HITS_PER_FILE,
               by: Sequence[str] = ()) -> DataFrame:
    """First ``per_file`` issues of every file, with the full count per file.

    ``by`` groups by run as well.  No file is left out; a rendered run
    (``compact_lint``) shows the first ones under a header with its totals.
    """
    keys = [*by, "file"]
    per = findings.groupBy(*keys).agg(F.count("*").alias("issues"))
    first = top_k_per_group(findings, keys, list(order), per_file)
    return first.join(per, keys).select(
        *keys, "issues", F.col("rank").cast("bigint").alias("rank"), "line_no", "col_no", "msg")


def ext_histogram(paths: DataFrame, path: str = "path", k: int = 8) -> DataFrame:
    return paths.groupBy(T.path_ext(F.col(path)).alias("ext")).agg(F.count("*").alias("n")) \
        .orderBy(F.col("n").desc(), "ext").limit(k)


def visible(rows: DataFrame, path: str = "path", show_all: bool = False) -> DataFrame:
    """Drop dot files unless ``show_all``."""
    return rows if show_all else rows.where(~F.startswith(T.path_base(F.col(path)), F.lit(".")))


def skip_dirs(rows: DataFrame, path: str = "path", names: tuple[str, ...] = P.SKIP_DIRS) -> DataFrame:
    """Drop files below noise directories."""
    return rows.where(~T.any_segment(F.col(path), names))


def path_rollup(files: DataFrame, path: str = "path", shown: int = 20) -> DataFrame:
    """Per directory: its files, its sub-directories and their child counts.

    Result: ``dir``, ``kind`` (``summary`` / ``dir`` / ``file``), ``name``,
    ``n_dirs``, ``n_files`` and ``children`` for sub-directories.
    """
    p = T.normal_path(F.col(path))
    file_rows = files.select(T.path_dir(p).alias("dir"), T.path_base(p).alias("name")).distinct()
    # Every proper prefix of a path is a directory.
    parts = F.split(p, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                           lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = files.where(F.contains(p, F.lit("/"))).select(F.explode(prefixes).alias("d")) \
        .where(F.col("d") != "").distinct()
    dir_rows = dirs.select(T.path_dir(F.col("d")).alias("dir"), F.col("d"), T.path_base(F.col("d")).alias("name"))
    entries = file_rows.select("dir", "name", F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("d")) \
        .unionByName(dir_rows.select("dir", "name", F.lit(True).alias("is_dir"), "d"))
    counts = entries.groupBy("dir").agg(F.count_if("is_dir").alias("n_dirs"),
                                        F.count_if(~F.col("is_dir")).alias("n_files"))
    children = counts.select(F.col("dir").alias("d"), (F.col("n_dirs") + F.col("n_files")).alias("children"))
    sub = entries.where("is_dir").join(children, "d").select(
        "dir", F.lit("dir").alias("kind"), "name", F.lit(None).cast("bigint").alias("n_dirs"),
        F.lit(None).cast("bigint").alias("n_files"), "children")
    first = top_k_per_group(entries.where(~F.col("is_dir")), ["dir"], ["name"], shown).select(
        "dir", F.lit("file").alias("kind"), "name", F.lit(None).cast("bigint").alias("n_dirs"),
        F.lit(None).cast("bigint").alias("n_files"), F.lit(None).cast("bigint").alias("children"))
    head = counts.select("dir", F.lit("summary").alias("kind"), F.lit("").alias("name"),
                         "n_dirs", "n_files", F.lit(None).cast("bigint").alias("children"))
    return head.unionByName(sub).unionByName(first)


def listing(rollup: DataFrame) -> DataFrame:
    """The rows of ``path_rollup`` in reading order: summary, directories by name, files by name."""
    place = F.when(F.col("kind") == "summary", 0).when(F.col("kind") == "dir", 1).otherwise(2)
    return rollup.orderBy("dir", place, "name")


def fold_prefix(paths: DataFrame, group: Sequence[str], path: str = "path") -> DataFrame:
    """Shared directory prefix of each group of paths ('' when there is none).

    The prefix of many paths is the prefix of the least and the greatest
    directory: two partial aggregates, never a list of paths.
    """
    segs = F.split(T.normal_path(F.col(path)), "/")
    rows = paths.select(*group, F.slice(segs, 1, F.size(segs) - 1).alias("_d"))
    ends = rows.groupBy(*group).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"),
                                    F.count("*").alias("paths"))
    bad = F.filter(F.sequence(F.lit(0), F.size("_lo")),
                   lambda i: F.get("_lo", i).isNull() | ~F.get("_lo", i).eqNullSafe(F.get("_hi", i)))
    common = F.slice("_lo", 1, F.get(bad, F.lit(0)))
    return ends.withColumn("_c", common).select(
        *group, "paths", F.when((F.col("paths") >= 3) & (F.size("_c") >= 2),
                                F.concat(F.array_join("_c", "/"), F.lit("/"))).otherwise(F.lit(""))
        .alias("prefix"))


def display_names(paths: DataFrame, folded: DataFrame, group: Sequence[str], path: str = "path") -> DataFrame:
    """Paths with the prefix of their group cut off.

    ``folded`` has one row per group.  A group may hold a large share of the
    paths; the adaptive skew join splits it.
    """
    j = paths.join(folded.select(*group, "prefix"), list(group))
    return j.withColumn("display", F.substring(T.normal_path(F.col(path)), F.length("prefix") + 1,
                                               F.lit(2147483647)))


# --- status codes ------------------------------------------------------------

def status_class(code: Column) -> Column:
    """Class of a two-letter porcelain code, in order of precedence."""
    out = F.lit(None).cast("string")
    for c in ("R", "D", "A", "M", "?"):
        out = F.when(F.contains(code, F.lit(c)), F.lit(c)).otherwise(out)
    return out


def status_counts(text: Column) -> Column:
    """Branch, counts by class and the first 60 entries of a porcelain status."""
    def build(lines: Column) -> Column:
        entries = F.filter(lines, lambda x: ~F.startswith(x, F.lit("##")) & (T.strip(x) != ""))
        branch = F.element_at(F.concat(
            F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("##"))),
                        lambda x: T.strip(F.substring(x, 3, 2147483647))),
            F.array(F.lit(""))), 1)

        def n(classes: Column, c: str) -> Column:
            return F.size(F.filter(classes, lambda k: k == c)).cast("bigint")

        return let(entries, lambda e: let(
            F.transform(e, lambda x: status_class(F.substring(x, 1, 2))),
            lambda k: F.struct(branch.alias("branch"), n(k, "M").alias("modified"),
                               n(k, "A").alias("added"), n(k, "D").alias("deleted"),
                               n(k, "R").alias("renamed"), n(k, "?").alias("untracked"),
                               F.slice(e, 1, P.MAX_LINES).alias("entries"))))
    return let(T.split_lines(text), build)


def status_rollup(runs: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    return runs.select(*keys, status_counts(F.col(text)).alias("s")).select(
        *keys, "s.branch", "s.modified", "s.added", "s.deleted", "s.renamed", "s.untracked")


def compact_status(text: Column) -> Column:
    s = status_counts(text)
    return let(s, lambda c: F.concat(
        F.lit("branch "), F.when(c["branch"] == "", "?").otherwise(c["branch"]), F.lit(" | "),
        c["modified"].cast("string"), F.lit("M "), c["added"].cast("string"), F.lit("A "),
        c["deleted"].cast("string"), F.lit("D "), c["renamed"].cast("string"), F.lit("R "),
        c["untracked"].cast("string"), F.lit(" untracked"),
        F.when(F.size(c["entries"]) > 0, F.concat(F.lit("\n"), T.join_lines(c["entries"])))
        .otherwise(F.lit(""))))


# --- diffs -------------------------------------------------------------------

def diff_files(text: Column) -> Column:
    """Files of a unified diff: array of (file, added, removed, lines).

    ``+++`` / ``---`` are headers only before the first hunk of a file, so a
    removed line that starts with ``--`` is kept.  Hunks outside any file
    header form a file without a name.
    """
    def one(seg: Column) -> Column:
        def content(rows: Column) -> Column:
            named = F.startswith(F.get(rows, 0), F.lit("diff --git"))
            found = F.regexp_extract(F.get(rows, 0), r" b/(.+)$", 1)
            name = F.when(~named, F.lit("")).when(found != "", found).otherwise(F.get(rows, 0))
            hunk_at = F.array_position(F.transform(rows, lambda x: F.startswith(x, F.lit("@@"))), F.lit(True)) - 1

            def changed(at: Column) -> Column:
                before = lambda i: (at < 0) | (i < at)
                head = lambda x: F.startswith(x, F.lit("+++")) | F.startswith(x, F.lit("---"))
                keep = F.filter(rows, lambda x, i: F.startswith(x, F.lit("@@")) | (
                    (F.startswith(x, F.lit("+")) | F.startswith(x, F.lit("-"))) & ~(before(i) & head(x))))
                return F.transform(keep, lambda x: F.when(
                    x.rlike(P.HUNK_RANGE), F.regexp_extract(x, P.HUNK_RANGE, 1)).otherwise(x))

            return let(let(hunk_at, changed), lambda c: F.struct(
                name.alias("file"),
                F.size(F.filter(c, lambda x: F.startswith(x, F.lit("+")))).cast("bigint").alias("added"),
                F.size(F.filter(c, lambda x: F.startswith(x, F.lit("-")))).cast("bigint").alias("removed"),
                named.alias("named"), c.alias("lines")))
        return let(T.split_lines(seg), content)
    segments = F.transform(F.split(text, r"(?m)^(?=diff --git)", -1), one)
    return F.filter(segments, lambda f: f["named"] | F.exists(
        f["lines"], lambda x: F.startswith(x, F.lit("@@"))))


def diff_stat(runs: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    """One row per changed file of every diff."""
    return runs.select(*keys, F.posexplode(diff_files(F.col(text))).alias("pos", "f")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), "f.file", "f.added", "f.removed",
        F.size("f.lines").cast("bigint").alias("changed_lines"))


def compact_diff(text: Column, per_file: int = P.DIFF_LINES_PER_FILE) -> Column:
    def render(files: Column) -> Column:
        def block(f: Column) -> Column:
            more = F.size(f["lines"]) - per_file
            head = F.concat(F.when(f["file"] == "", "(unnamed)").otherwise(f["file"]), F.lit("  (+"),
                            f["added"].cast("string"), F.lit(" -"), f["removed"].cast("string"), F.lit(")"))
            return F.concat(
                F.array(head),
                F.transform(F.slice(f["lines"], 1, per_file), lambda x: F.concat(F.lit("  "), T.clip_line(x))),
                F.when(more > 0, F.array(F.concat(F.lit("  ...(+"), more.cast("string"), F.lit(" changed lines)"))))
                .otherwise(F.array().cast("array<string>")))
        return F.when(F.size(files) == 0, F.lit("no changes")).otherwise(T.join_lines(F.concat(
            F.array(F.concat(F.size(files).cast("string"), F.lit(" file(s) changed"))),
            F.flatten(F.transform(files, block)))))
    return let(diff_files(text), render)


def compact_show(text: Column) -> Column:
    """Commit header (first 8 non-blank lines) and the compacted diff."""
    at = F.locate("\ndiff --git", text)
    header = F.slice(F.filter(T.split_lines(T.strip(F.substring(text, F.lit(1), at - 1))),
                              lambda x: T.strip(x) != ""), 1, 8)
    return F.when(at == 0, T.join_lines(A.head_tail(T.split_lines(text), P.SHORT_LINES))).otherwise(
        F.concat(T.join_lines(header), F.lit("\n"),
                 compact_diff(F.substring(text, at + 1, F.lit(2147483647)))))


# --- aligned text tables -----------------------------------------------------

def table_lines(text: Column) -> Column:
    return F.filter(T.split_lines(text), lambda x: T.strip(x) != "")


def cells(line: Column) -> Column:
    return F.split(T.strip(line), P.CELL_GAP, -1)


def read_text_table(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Aligned text tables: one row per body row with ``header`` and ``cells``."""
    t = docs.select(*keys, table_lines(F.col(text)).alias("_l")).select(
        *keys, cells(F.get("_l", F.lit(0))).alias("header"),
        F.posexplode(F.slice("_l", 2, F.size("_l"))).alias("row_no", "_r"))
    body = t.where(~F.col("_r").rlike(P.SEPARATOR_ROW))
    return body.select(*keys, (F.col("row_no") + 1).cast("bigint").alias("row_no"), "header",
                       cells(F.col("_r")).alias("cells"))


def cell(name: str) -> Column:
    """Cell of a named column (any case) of ``read_text_table``, null if absent."""
    at = F.array_position(F.transform("header", lambda h: F.upper(h)), F.lit(name.upper()))
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def compact_table(text: Column, drop: Sequence[str] | Column = (), max_rows: int = P.TABLE_LINES) -> Column:
    """Drop named columns and separator rows; rows of other width stay whole."""
    def build(lines: Column) -> Column:
        def with_header(cols: Column) -> Column:
            def row(line: Column) -> Column:
                def out(parts: Column) -> Column:
                    kept = parts
                    if isinstance(drop, Column):
                        kept = F.filter(parts, lambda _, i: ~F.array_contains(drop, F.upper(F.get(cols, i))))
                    elif drop:
                        names = [d.upper() for d in drop]
                        kept = F.filter(parts, lambda _, i: ~F.upper(F.get(cols, i)).isin(*names))
                    return F.when(F.size(parts) == F.size(cols), F.array_join(kept, "  ")) \
                        .otherwise(T.strip(line))
                return let(cells(line), out)
            body = F.filter(lines, lambda x: ~x.rlike(P.SEPARATOR_ROW))
            return F.when((F.size(lines) < 2) | (F.size(cols) < 2), T.split_lines(text)) \
                .otherwise(F.transform(body, row))
        return let(cells(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), with_header)
    return T.join_lines(A.head_tail(let(table_lines(text), build), max_rows))


def looks_tabular(text: Column) -> Column:
    return F.exists(F.array(table_lines(text)), lambda lines: (F.size(lines) >= 3)
                    & (F.size(cells(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))) >= 2))


def pod_rows(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Pods of status tables with typed restarts and the anomaly flag."""
    t = read_text_table(docs, keys, text)
    at = F.array_position(F.transform("header", lambda h: F.upper(h)), F.lit("STATUS"))
    named = F.array_contains(F.transform("header", lambda h: F.upper(h)), F.lit("NAME"))
    rows = t.where((at > 0) & named & (F.size("cells") >= at)).select(
        *keys, "row_no", F.coalesce(cell("NAME"), F.lit("?")).alias("name"), cell("STATUS").alias("status"),
        F.coalesce(F.regexp_extract(cell("RESTARTS"), r"^(\d+)", 1).try_cast("bigint"), F.lit(0)).alias("restarts"),
        F.coalesce(cell("AGE"), F.lit("?")).alias("age"), cell("NODE").alias("node"))
    return rows.withColumn("anomaly", ~F.col("status").isin(*P.HEALTHY_STATUS) | (F.col("restarts") > 0))


def pod_summary(pods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pods, anomalies and restarts per status (and group)."""
    return pods.groupBy(*by, "status").agg(
        F.count("*").alias("pods"), F.count_if("anomaly").alias("anomalies"),
        F.sum("restarts").alias("restarts"))


def compact_pods(text: Column) -> Column:
    """``N pods | counts by status`` and up to 30 anomaly lines; null if no pods."""
    def build(lines: Column) -> Column:
        def with_header(cols: Column) -> Column:
            def at(name: str) -> Column:
                return (F.array_position(cols, F.lit(name)) - 1).cast("int")

            def pod(line: Column) -> Column:
                def fields(parts: Column) -> Column:
                    def get(name: str) -> Column:
                        return F.when(at(name) >= 0, F.get(parts, at(name)))
                    return F.struct(
                        F.get(parts, at("STATUS")).alias("status"),
                        F.coalesce(F.get(parts, at("NAME")), F.lit("?")).alias("name"),
                        F.coalesce(F.regexp_extract(get("RESTARTS"), r"^(\d+)", 1).try_cast("bigint"),
                                   F.lit(0)).alias("restarts"),
                        F.coalesce(get("AGE"), F.lit("?")).alias("age"),
                        F.coalesce(F.concat(F.lit("  node="), get("NODE")), F.lit("")).alias("node"))
                return let(cells(line), fields)

            def render(pods: Column) -> Column:
                kinds = F.array_distinct(F.transform(pods, lambda p: p["status"]))
                counted = F.transform(kinds, lambda k, i: F.struct(
                    (-F.size(F.filter(pods, lambda p: p["status"] == k))).alias("neg"), i.alias("i"), k.alias("k")))
                by_count = F.transform(F.sort_array(counted), lambda c: F.concat(
                    (-c["neg"]).cast("string"), F.lit(" "), c["k"]))
                bad = F.filter(pods, lambda p: ~p["status"].isin(*P.HEALTHY_STATUS) | (p["restarts"] > 0))
                detail = F.transform(F.slice(bad, 1, 30), lambda p: F.concat(
                    F.lit("! "), p["name"], F.lit("  "), p["status"], F.lit("  restarts="),
                    p["restarts"].cast("string"), F.lit("  age="), p["age"], p["node"]))
                head = F.concat(F.size(pods).cast("string"), F.lit(" pods | "), F.array_join(by_count, ", "))
                return F.when(F.size(pods) > 0, T.join_lines(F.concat(F.array(head), detail)))

            pods = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), pod), lambda p: p["status"].isNotNull())
            return F.when((F.size(lines) >= 2) & (at("STATUS") >= 0) & (at("NAME") >= 0), let(pods, render))
        return let(F.transform(cells(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), lambda h: F.upper(h)),
                   with_header)
    return let(table_lines(text), build)
