"""Shape detection and per-shape compaction of any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T
from loomsift.functions.text import let
from loomsift.operators import findings, jsonops, profiles


def has(text: Column, *words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(text, F.lit(w))
    return out


def looks_training(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(P.EPOCH_MARK)) >= 3) | (F.regexp_count(text, F.lit(P.EPOCH_LINE)) >= 3)


def classify_shape(text: Column) -> Column:
    """Label of a text; the first test that holds wins, cheap tests first."""
    def label(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        frame = has(t, "pandas.core.frame.DataFrame") | has(t, "Data columns (total")
        trace = (has(t, "Traceback (most recent call last)")
                 | (has(t, "at ") & t.rlike(P.FRAME_AT)) | (has(t, 'File "') & t.rlike(P.FRAME_FILE)))
        return (F.when(t == "", "empty")
                .when(T.binary_reason(t).isNotNull(), "binary")
                .when(first.isin("{", "[") & F.try_parse_json(t).isNotNull(), "json")
                .when(has(t, "diff --git") | (has(t, "@@ ") & t.rlike(P.HUNK_LINE)), "diff")
                .when(frame, "frame_info")
                .when(has(t, "precision", "recall", "f1-score") & t.rlike(P.REPORT_ROW), "class_report")
                .when(has(F.lower(t), "epoch") & looks_training(t), "training")
                .when(trace, "trace")
                .otherwise("text"))
    return let(T.strip(T.strip_bom(text)), label)


def compact_log(text: Column, limit: int = P.LOG_LINES) -> Column:
    """Control codes and progress out, repeats collapsed, head and tail kept."""
    return T.join_lines(A.head_tail(A.smart_dedup(A.drop_progress(
        T.split_lines(T.clean_control(text)))), limit))


def compact_container_log(text: Column) -> Column:
    return compact_log(text, P.TABLE_LINES)


def compact_journal(text: Column) -> Column:
    return T.join_lines(A.head_tail(A.smart_dedup(T.split_lines(T.clean_control(text))), P.LOG_LINES))


def compact_generic(text: Column, limit: int = P.MAX_LINES) -> Column:
    return T.join_lines(A.head_tail(A.dedup_consecutive(A.drop_progress(
        T.split_lines(T.clean_control(text)))), limit))


def compact_trace(text: Column) -> Column:
    """Frames and error lines of a stack trace, library runs collapsed."""
    def render(lines: Column) -> Column:
        kept = A.collapse_library_frames(A.trace_lines(lines))
        return let(kept, lambda k: T.join_lines(A.head_tail(
            F.when(F.size(k) > 0, k).otherwise(lines), P.LOG_LINES)))
    return let(T.split_lines(text), render)


def binary_note(text: Column) -> Column:
    return F.concat(F.lit("[~"), T.kilobytes(text).cast("string"),
                    F.lit("KB of binary or base64-like content suppressed]"))


def compact_response(text: Column) -> Column:
    """HTTP response: binary suppressed, inline blobs noted, HTML to visible text, 40 lines."""
    def render(raw: Column) -> Column:
        return let(T.without_blobs(raw), lambda t: F.when(T.binary_reason(raw).isNotNull(), binary_note(raw)).otherwise(readable(t)))

    def readable(t: Column) -> Column:
        visible = F.when(t.rlike(P.HTML_PAGE), T.html_to_text(t)).otherwise(t)
        return T.join_lines(A.head_tail(T.split_lines(visible), P.RESPONSE_LINES))
    return let(T.join_lines(A.drop_progress(T.split_lines(text))), render)


def errors_only(text: Column) -> Column:
    found = T.join_lines(A.error_lines(T.split_lines(text), 1))
    return F.when(found == "", F.lit("(no error lines detected)")).otherwise(found)


def fail_wrap(compact: Column, raw: Column, code: Column) -> Column:
    """A failing run shows its error lines, if it has any."""
    found = F.nullif(T.join_lines(A.error_lines(T.split_lines(raw), 1)), F.lit(""))
    return F.when(code != 0, F.coalesce(found, compact)).otherwise(compact)


def describe_fields(text: Column) -> Column:
    """Top-level ``Key:`` lines and everything from ``Events:`` on."""
    def keep(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.startswith(T.strip(x), F.lit("Events:"))), F.lit(True))
        return let(at, lambda a: T.join_lines(A.head_tail(F.filter(
            lines, lambda x, i: ((a > 0) & (i >= a - 1))
            | (x.rlike(P.DESCRIBE_FIELD) & (F.length(T.strip(x)) < 200))), P.LOG_LINES)))
    return let(T.split_lines(text), keep)


def _kept_or(text: Column, keep, kept_limit: int, fallback: int) -> Column:
    def render(lines: Column) -> Column:
        return let(F.filter(lines, keep), lambda k: F.when(
            F.size(k) > 0, T.join_lines(A.head_tail(k, kept_limit)))
            .otherwise(T.join_lines(A.head_tail(lines, fallback))))
    return let(T.split_lines(text), render)


def status_fields(text: Column) -> Column:
    return _kept_or(text, T.is_status_field, P.SHORT_LINES, P.FALLBACK_LINES)


def plan_text_lines(text: Column) -> Column:
    return _kept_or(text, T.is_plan_line, P.LOG_LINES, P.FALLBACK_LINES)


def train_run(text: Column) -> Column:
    return F.coalesce(profiles.compact_training(text), compact_generic(text, P.RESPONSE_LINES))


def compact_shape(shape: Column, text: Column) -> Column:
    """Compact text of every shape but JSON."""
    t = T.strip(T.strip_bom(text))
    return (F.when(shape == "empty", F.lit(""))
            .when(shape == "binary", binary_note(t))
            .when(shape == "diff", findings.compact_diff(t))
            .when(shape == "training", F.coalesce(profiles.compact_training(t), compact_log(t, P.MAX_LINES)))
            .when(shape == "trace", compact_trace(t))
            .otherwise(compact_log(t, P.MAX_LINES)))


def auto_compact(docs: DataFrame, key: str, text: str = "text", mask: bool = True,
                 strict: bool = True) -> DataFrame:
    """Detect the shape of every text and compact it in its row.

    Result: input columns, ``shape``, ``compact``, ``redacted``.
    """
    shaped = docs.withColumn("shape", classify_shape(F.col(text)))
    # Nested deeper than the shape test goes, a document still opens; what opens nothing is masked as text.
    like = (F.col("shape") == "text") & F.substring(T.strip(T.strip_bom(F.col(text))), 1, 1).isin("{", "[")
    as_json = jsonops.compact_json(F.when((F.col("shape") == "json") | like, F.col(text)), mask)
    both = shaped.withColumn("_j", as_json).withColumn("shape", F.when(F.col("_j").isNotNull(), "json").otherwise(F.col("shape"))).withColumn("_c", F.when(F.col("_j").isNull(), compact_shape(F.col("shape"), F.col(text))))
    members = F.when(like, T.redact_members(F.col("_c"))).otherwise(F.col("_c"))
    masked = T.redact(members, strict) if mask else F.col("_c")
    return both.withColumn("compact", F.coalesce("_j.compact", masked)) \
        .withColumn("redacted", F.coalesce("_j.redacted", F.col("compact") != F.col("_c"))).drop("_j", "_c")
