"""Ordered line operators on ``array<string>`` columns.

One array holds the lines of one text, in order.  Every operator is a narrow
projection: linear or n log n in the lines of the row, no exchange, no state
shared between rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions.text import (
    clip_line, est_tokens, is_error, is_library_frame, is_progress, is_trace_line,
    join_lines, let, line_template, split_lines, strip,
)


def positions(lines: Column) -> Column:
    """0-based positions of an array."""
    return F.transform(lines, lambda _, i: i)


def segments(lines: Column, is_head: Callable[[Column], Column]) -> Column:
    """Cut lines at head lines: array of (head, body).

    The first element holds what comes before the first head (``head`` null).
    """
    def build(rows: Column) -> Column:
        def cut(heads: Column) -> Column:
            first = F.struct(F.lit(None).cast("string").alias("head"),
                             F.slice(rows, 1, F.coalesce(F.get(heads, F.lit(0)), F.size(rows))).alias("body"))
            rest = F.transform(heads, lambda h, j: F.struct(
                F.get(rows, h).alias("head"),
                F.slice(rows, h + 2, F.coalesce(F.get(heads, j + 1), F.size(rows)) - h - 1).alias("body")))
            return F.concat(F.array(first), rest)
        return let(F.filter(positions(rows), lambda i: is_head(F.get(rows, i))), cut)
    return let(lines, build)


def times(n: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("  (x"), n.cast("string"), F.lit(suffix + ")"))


def drop_progress(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_progress(x))


def run_starts(keys: Column, breaks: Callable[[Column], Column] | None = None) -> Column:
    """Positions where a run of equal keys begins; ``breaks`` forces a start."""
    def starts(i: Column) -> Column:
        new = (i == 0) | (F.get(keys, i) != F.get(keys, i - 1))
        return new | breaks(F.get(keys, i)) if breaks else new
    return F.filter(positions(keys), starts)


def dedup_by(lines: Column, key: Callable[[Column], Column] | None = None) -> Column:
    """Collapse runs of lines with an equal key to the first line and a count."""
    def collapse(rows: Column) -> Column:
        def with_keys(keys: Column) -> Column:
            def with_starts(starts: Column) -> Column:
                def emit(s: Column, j: Column) -> Column:
                    n = F.coalesce(F.get(starts, j + 1), F.size(rows)) - s
                    line = F.get(rows, s)
                    return F.when(n > 1, F.concat(line, times(n))).otherwise(line)
                return F.transform(starts, emit)
            return let(run_starts(keys), with_starts)
        return let(F.transform(rows, key) if key else rows, with_keys)
    return let(lines, collapse)


def dedup_consecutive(lines: Column) -> Column:
    return dedup_by(lines)


def smart_dedup(lines: Column, min_total: int = P.SMART_DEDUP_MIN_TOTAL) -> Column:
    """Collapse repeats that differ only in their timestamp prefix.

    Runs become ``line  (xN)``.  A template that comes back later and occurs at
    least ``min_total`` times keeps its first line as ``line  (xN total)``.
    Blank templates never merge.  Sorting the runs by template brings equal
    templates together, so totals need no lookup per run.
    """
    def blank(k: Column) -> Column:
        return strip(k) == ""

    def collapse(rows: Column, keys: Column) -> Column:
        def from_runs(runs: Column) -> Column:
            def from_sorted(srt: Column) -> Column:
                def from_heads(heads: Column) -> Column:
                    def group(h: Column, j: Column) -> Column:
                        size = F.coalesce(F.get(heads, j + 1), F.size(srt)) - h
                        members = F.slice(srt, h + 1, size)
                        total = F.aggregate(members, F.lit(0), lambda a, r: a + r["n"])
                        again = (size > 1) & (total >= min_total)
                        first = F.get(srt, h)
                        once = F.array(F.struct(first["at"].alias("at"), total.alias("n"),
                                                F.lit(True).alias("all")))
                        each = F.transform(members, lambda r: F.struct(
                            r["at"].alias("at"), r["n"].alias("n"), F.lit(False).alias("all")))
                        return F.when(again, once).otherwise(each)
                    return F.flatten(F.transform(heads, group))
                named = F.filter(
                    positions(srt),
                    lambda i: (i == 0) | (F.get(srt, i)["k"] != F.get(srt, i - 1)["k"]))
                return let(named, from_heads)

            words = F.filter(runs, lambda r: ~blank(r["k"]))
            blanks = F.transform(
                F.filter(runs, lambda r: blank(r["k"])),
                lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n"), F.lit(False).alias("all")))
            kept = let(F.sort_array(words), from_sorted)

            def emit(r: Column) -> Column:
                line = F.get(rows, r["at"])
                return (F.when(r["all"], F.concat(line, times(r["n"], " total")))
                        .when(r["n"] > 1, F.concat(line, times(r["n"])))
                        .otherwise(line))
            return F.transform(F.sort_array(F.concat(kept, blanks)), emit)

        def runs_of(starts: Column) -> Column:
            return F.transform(starts, lambda s, j: F.struct(
                F.get(keys, s).alias("k"), s.alias("at"),
                (F.coalesce(F.get(starts, j + 1), F.size(rows)) - s).alias("n")))
        return let(let(run_starts(keys, blank), runs_of), from_runs)

    def start(rows: Column) -> Column:
        def with_keys(keys: Column) -> Column:
            words = F.filter(keys, lambda k: ~blank(k))
            # Most texts repeat nothing: one hash pass settles them.
            unique = let(words, lambda w: F.size(F.array_distinct(w)) == F.size(w))
            return F.when(unique, rows).otherwise(collapse(rows, keys))
        return let(F.transform(rows, line_template), with_keys)
    return let(lines, start)


def head_tail(lines: Column, limit: int | Column = P.MAX_LINES) -> Column:
    """First two thirds and last third of ``limit`` lines around a marker."""
    if isinstance(limit, int):
        head, total = F.lit(limit * 2 // 3), F.lit(limit)
    else:
        head, total = F.floor(limit * 2 / 3).cast("int"), limit

    def cut(rows: Column) -> Column:
        marker = F.concat(F.lit("... ["), (F.size(rows) - total).cast("string"), F.lit(" lines omitted] ..."))
        clipped = F.when(F.size(rows) <= total, rows).otherwise(
            F.concat(F.slice(rows, 1, head), F.array(marker), F.slice(rows, head - total, total - head)))
        return F.transform(clipped, lambda x: clip_line(x))
    return let(lines, cut)


def error_lines(lines: Column, context: int = 0) -> Column:
    """Lines that report an error, with ``context`` neighbours on each side."""
    if context == 0:
        return F.filter(lines, is_error)

    def keep(rows: Column) -> Column:
        def near(hits: Column) -> Column:
            def hit_near(_: Column, i: Column) -> Column:
                out = F.get(hits, i)
                for k in range(1, context + 1):
                    out = (out | F.coalesce(F.get(hits, i - k), F.lit(False))
                           | F.coalesce(F.get(hits, i + k), F.lit(False)))
                return out
            return F.filter(rows, hit_near)
        return let(F.transform(rows, is_error), near)
    return let(lines, keep)


def collapse_library_frames(lines: Column) -> Column:
    """Replace runs of two or more library frames by one marker line."""
    def collapse(rows: Column) -> Column:
        def with_flags(lib: Column) -> Column:
            starts_of = F.filter(positions(rows), lambda i: ~F.get(lib, i)
                                 | (i == 0) | ~F.get(lib, i - 1))

            def with_starts(starts: Column) -> Column:
                def emit(s: Column, j: Column) -> Column:
                    n = F.coalesce(F.get(starts, j + 1), F.size(rows)) - s
                    marker = F.concat(F.lit("  ... ["), n.cast("string"),
                                      F.lit(" library frames collapsed] ..."))
                    return F.when(n > 1, marker).otherwise(F.get(rows, s))
                return F.transform(starts, emit)
            return let(starts_of, with_starts)
        return let(F.transform(rows, is_library_frame), with_flags)
    return let(lines, collapse)


def trace_lines(lines: Column) -> Column:
    return F.filter(lines, is_trace_line)


def with_occurrence(lines: Column) -> Column:
    """Each line with its occurrence number (1, 2, ...) among equal lines."""
    def number(srt: Column) -> Column:
        def with_heads(heads: Column) -> Column:
            def group(h: Column, j: Column) -> Column:
                n = F.coalesce(F.get(heads, j + 1), F.size(srt)) - h
                return F.transform(F.slice(srt, h + 1, n), lambda r, i: F.struct(
                    r["line"].alias("line"), (i + 1).alias("occurrence")))
            return F.flatten(F.transform(heads, group))
        return let(F.filter(positions(srt), lambda i: (i == 0)
                            | (F.get(srt, i)["line"] != F.get(srt, i - 1)["line"])), with_heads)
    return let(F.sort_array(F.transform(lines, lambda x, i: F.struct(
        x.alias("line"), i.alias("at")))), number)


def budget(text: Column, tokens: int) -> Column:
    """Shrink a text until it fits ``tokens``; the note counts against them."""
    note = f"[output capped at ~{tokens} tokens]"

    def step(ladder: tuple[int, ...], lines: Column) -> Column:
        if not ladder:
            keep = max(0, tokens * P.CHARS_PER_TOKEN - len(note) - 8)
            return F.concat(F.substring(text, 1, keep), F.lit("\n...\n" + note))
        cut = F.concat(join_lines(head_tail(lines, ladder[0])), F.lit("\n" + note))
        return let(cut, lambda c: F.when(est_tokens(c) <= tokens, c)
                   .otherwise(step(ladder[1:], lines)))

    if tokens <= 0:
        return text
    return F.when(est_tokens(text) <= tokens, text).otherwise(
        let(split_lines(text), lambda lines: step(P.BUDGET_LADDER, lines)))


def size_floor(raw: Column, compact: Column, redacted: Column) -> Column:
    """Never larger than raw, unless secrets were taken out."""
    return F.when(~redacted & (F.length(compact) > F.length(raw)), raw).otherwise(compact)


def fold_prefix(paths: Column) -> Column:
    """Directory prefix shared by three or more paths over two or more levels.

    The common prefix of many segment arrays is that of the least and the
    greatest one.  Returns '' when there is none.
    """
    def prefix(dirs: Column) -> Column:
        low, high = F.array_min(dirs), F.array_max(dirs)

        def shared(lo: Column) -> Column:
            return let(high, lambda hi: let(
                F.filter(F.transform(lo, lambda s, i: F.when(~F.get(hi, i).eqNullSafe(s), i)),
                         lambda x: x.isNotNull()),
                lambda bad: F.slice(lo, 1, F.coalesce(F.get(bad, F.lit(0)), F.size(lo)))))
        return let(let(low, shared), lambda common: F.when(
            (F.size(dirs) >= 3) & (F.size(common) >= 2),
            F.concat(F.array_join(common, "/"), F.lit("/"))).otherwise(F.lit("")))
    return let(F.transform(paths, lambda p: let(
        F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"),
        lambda s: F.slice(s, 1, F.size(s) - 1))), prefix)


def grouped(entries: Column) -> Column:
    """Group an array of (k, at, ...) structs by ``k``: array of (at, k, members).

    Groups come in order of their first member, members in order of ``at``.
    """
    def with_sorted(srt: Column) -> Column:
        def with_heads(heads: Column) -> Column:
            return F.transform(heads, lambda h, j: F.struct(
                F.get(srt, h)["at"].alias("at"), F.get(srt, h)["k"].alias("k"),
                F.slice(srt, h + 1, F.coalesce(F.get(heads, j + 1), F.size(srt)) - h).alias("members")))
        return F.sort_array(let(F.filter(positions(srt), lambda i: (i == 0)
                            | (F.get(srt, i)["k"] != F.get(srt, i - 1)["k"])), with_heads))
    return let(F.sort_array(entries), with_sorted)


def grouped_lines(entries: Column, unit: str, per_group: int, groups: int, total: Column) -> Column:
    """Header, shared prefix and the first entries of every group of hits.

    ``entries`` is an array of (k: file, at, show: text of the hit).
    """
    def render(gs: Column) -> Column:
        shown = F.slice(gs, 1, groups)

        def with_prefix(pre: Column) -> Column:
            def block(g: Column) -> Column:
                n = F.size(g["members"])
                return F.concat(
                    F.array(F.concat(F.substring(F.replace(g["k"], F.lit("\\"), F.lit("/")), F.length(pre) + 1,
                                                 F.lit(2147483647)),
                                     F.lit("  ("), n.cast("string"), F.lit(")"))),
                    F.transform(F.slice(g["members"], 1, per_group), lambda m: F.concat(F.lit("  "), m["show"])),
                    F.when(n > per_group, F.array(F.concat(F.lit("  ...(+"), (n - per_group).cast("string"),
                                                           F.lit(")"))))
                    .otherwise(F.array().cast("array<string>")))
            head = F.concat(total.cast("string"), F.lit(f" {unit} in "), F.size(gs).cast("string"), F.lit(" file(s)"))
            return join_lines(F.concat(
                F.array(head),
                F.when(pre != "", F.array(F.concat(F.lit("in "), pre))).otherwise(F.array().cast("array<string>")),
                F.flatten(F.transform(shown, block))))
        return F.when(F.size(gs) > 0, let(fold_prefix(F.transform(shown, lambda g: g["k"])), with_prefix))
    return let(grouped(entries), render)
