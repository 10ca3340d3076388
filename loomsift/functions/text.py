"""Column expressions over one text column.

Everything here is a Spark expression: no Python runs on the executors and no
row is moved.  A text stays inside its row, so work on it parallelises with the
table and never depends on how documents are keyed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsift import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A lambda variable of a higher-order function holds a computed value, so the
    optimizer cannot inline the expression again inside a per-element lambda.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(P.WHITESPACE))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def est_tokens(text: Column) -> Column:
    """Four characters per token, rounded up; 0 for an empty text."""
    return F.shiftright(F.length(text) + 3, 2)


def strip_ansi(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\x1b")),
                  F.regexp_replace(text, P.ANSI, "")).otherwise(text)


def strip_bom(text: Column) -> Column:
    out = text
    for bom in reversed(P.BOMS):
        out = F.when(F.startswith(text, F.lit(bom)),
                     F.substring(text, len(bom) + 1, 2147483647)).otherwise(out)
    return out


def last_redraw(text: Column) -> Column:
    """Keep the last carriage-return state of every line; CRLF is a line end."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    # (?d): only \n ends a line, so each line start is tried once.
    return F.when(F.contains(text, F.lit("\r")),
                  F.regexp_replace(unix, P.REDRAWN, "")).otherwise(text)


def clean_control(text: Column) -> Column:
    return let(strip_bom(text), lambda t: let(strip_ansi(t), last_redraw))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-case form of the text holds any of the words.

    The words are one constant of the plan, not one node each: large
    expressions use this test many times.
    """
    constant = F.split(F.lit("\n".join(words)), "\n")
    return F.exists(F.array(F.lower(text)), lambda low: F.exists(constant, lambda w: F.contains(low, w)))


def has_secret_hint(text: Column) -> Column:
    return contains_any(text, P.SECRET_HINTS)


# A match can only begin at a word start (the leading class is greedy), and
# saying so keeps the scan linear on very long unbroken words.
GUARDED_ASSIGN = P.SECRET_ASSIGN.replace("(?i)(", "(?i)(?<![A-Za-z0-9_.-])(", 1)


def redact(text: Column, strict: bool = True) -> Column:
    """Mask secret-looking assignments and token shapes.

    ``strict`` also masks the value after ``Bearer``.
    """
    out = text
    if strict:
        out = F.regexp_replace(out, P.BEARER_VALUE, "$1" + P.MASK)
    out = F.regexp_replace(out, GUARDED_ASSIGN, "$1$2" + P.MASK)
    out = F.regexp_replace(out, P.SECRET_TOKEN, P.MASK)
    return F.when(has_secret_hint(text), out).otherwise(text)


def redact_members(text: Column) -> Column:
    """Mask the values of secret-looking keys in a text that looks like JSON but is none."""
    return F.when(has_secret_hint(text), F.regexp_replace(text, P.SECRET_MEMBER, '$1"' + P.MASK + '"')).otherwise(text)


def html_to_text(html: Column) -> Column:
    t = F.regexp_replace(html, P.HTML_DROP_ELEMENT, " ")
    t = F.regexp_replace(t, P.HTML_COMMENT, " ")
    t = F.regexp_replace(t, P.HTML_LINE_END, "\n")
    t = F.regexp_replace(t, P.HTML_TAG, " ")
    for entity, char in P.HTML_ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    lines = F.transform(split_lines(t), strip)
    return join_lines(F.filter(lines, lambda x: x != ""))


def without_blobs(text: Column) -> Column:
    """The text with long base64-like runs (inline images, archives) replaced by a note."""
    return F.regexp_replace(text, P.BASE64_RUN, P.BLOB_NOTE)


def binary_reason(text: Column, sample: int | None = None) -> Column:
    """``nul``, ``control``, ``base64`` or null for readable text.

    The whole text decides.  ``sample`` sniffs its first characters only, and then any
    long base64 run counts, not just one that makes up most of the text.
    """
    head = F.substring(text, 1, sample) if sample else text

    def reason(s: Column) -> Column:
        control = F.length(s) - F.length(F.regexp_replace(s, P.CONTROL_CHARS, ""))
        blob = s.rlike(P.BASE64_RUN) if sample else F.length(F.regexp_replace(s, P.BASE64_RUN, "")) * 2 < F.length(s)
        return (F.when(F.contains(s, F.lit("\x00")), F.lit("nul"))
                .when(control > F.length(s) * P.BINARY_CONTROL_SHARE, F.lit("control"))
                .when(blob, F.lit("base64")))

    return let(head, reason)


def kilobytes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 1024).cast("int"))


def line_template(line: Column) -> Column:
    """The line without its timestamp prefix: equal templates are repeats."""
    return F.regexp_replace(line, P.TIMESTAMP_PREFIX, "")


def clip_line(line: Column, limit: int = P.MAX_LINE_CHARS) -> Column:
    extra = F.length(line) - limit
    return F.when(extra > 0, F.concat(F.substring(line, 1, limit), F.lit(" ...[+"),
                                      extra.cast("string"), F.lit(" chars]"))).otherwise(line)


def is_error(line: Column) -> Column:
    # Byte searches settle most lines; the pattern confirms the word edges.
    return (contains_any(line, P.ERROR_HINTS) | line.rlike(P.ERROR_CODE_HINT)) & line.rlike(P.ERROR_LINE)


def is_progress(line: Column) -> Column:
    s = strip(line)
    noise = s.rlike(P.PROGRESS_PERCENT) | s.rlike(P.PROGRESS_VERB)
    # A line that reports an error is never progress noise.
    return (s != "") & noise & ~is_error(line)


def is_signature(line: Column) -> Column:
    return line.rlike(P.SIGNATURE_LINE)


def is_trace_line(line: Column) -> Column:
    s = strip(line)
    return (F.startswith(s, F.lit('File "')) | F.startswith(s, F.lit("Traceback"))
            | F.startswith(s, F.lit("at ")) | F.startswith(s, F.lit("Caused by"))
            | s.rlike(P.EXCEPTION_LINE) | is_error(s))


def is_library_frame(line: Column) -> Column:
    s = strip(line)
    frame = F.startswith(s, F.lit('File "')) | F.startswith(s, F.lit("at "))
    return frame & s.rlike(P.LIBRARY_FRAME)


def is_status_field(line: Column) -> Column:
    s = strip(line)
    return s.rlike(P.STATUS_FIELD) | is_error(s)


def is_plan_line(line: Column) -> Column:
    s = strip(line)
    words = reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in P.PLAN_WORDS])
    return s.rlike(P.PLAN_LINE) | words | is_error(s)


def is_secret_key(key: Column) -> Column:
    return key.rlike(P.SECRET_KEY)


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_base(path: Column) -> Column:
    return F.substring_index(normal_path(path), "/", -1)


def path_dir(path: Column) -> Column:
    p = normal_path(path)
    return F.when(F.contains(p, F.lit("/")),
                  F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def path_ext(path: Column) -> Column:
    """Extension of the base name, ``(none)`` without one."""
    b = path_base(path)
    return F.when(F.contains(b, F.lit(".")), F.substring_index(b, ".", -1)).otherwise(F.lit("(none)"))


def any_segment(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(normal_path(path), "/"), F.array(*[F.lit(n) for n in names]))


def saved_columns(raw: Column, out: Column) -> tuple[Column, Column]:
    """(tokens saved, percent saved); 0 % of nothing is 0."""
    saved = raw - out
    return saved, F.coalesce(F.try_divide(saved * F.lit(100.0), raw), F.lit(0.0))
