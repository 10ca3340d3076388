"""Text jobs: cleaning, redaction, screening and metering of document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T


def token_meter(docs: DataFrame, by: Sequence[str], text: str = "text",
                quantiles: bool = True) -> DataFrame:
    """Tokens per group, their average, largest and (``quantiles``) 95th percentile; all partial aggregates."""
    rows = docs.select(*by, T.est_tokens(F.col(text)).alias("tokens"))
    aggs = [F.count("*").alias("docs"), F.sum("tokens").alias("tokens"),
            F.avg("tokens").alias("avg_tokens"), F.max("tokens").alias("max_tokens")]
    if quantiles:
        aggs.append(F.percentile_approx("tokens", 0.95, 100_000).alias("p95_tokens"))
    return rows.groupBy(*by).agg(*aggs)


def clean_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its visible state; add what was taken out.

    ``ansi_chars``, ``bom_chars`` and ``redraw_chars`` count removed characters.
    """
    c = F.col(text)
    no_bom = T.strip_bom(c)
    no_ansi = T.strip_ansi(no_bom)
    out = T.last_redraw(no_ansi)
    return docs.withColumns({
        "bom_chars": F.length(c) - F.length(no_bom),
        "ansi_chars": F.length(no_bom) - F.length(no_ansi),
        "redraw_chars": F.length(no_ansi) - F.length(out),
        text: out})


def redact_corpus(docs: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """Mask secrets in place and add the taint column ``redacted``."""
    masked = T.redact(F.col(text), strict)
    return docs.withColumns({"masked": masked}) \
        .withColumn("redacted", F.col("masked") != F.col(text))


def redaction_facts(docs: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Secret hits by kind and group."""
    c = F.col(text)
    hint = T.has_secret_hint(c)
    rows = docs.where(hint).select(
        *by, F.regexp_count(c, F.lit(T.GUARDED_ASSIGN)).alias("assignments"),
        F.regexp_count(c, F.lit(P.SECRET_TOKEN)).alias("token_shapes"))
    return rows.groupBy(*by).agg(
        F.sum("assignments").alias("assignments"), F.sum("token_shapes").alias("token_shapes"),
        F.count_if(F.col("assignments") + F.col("token_shapes") > 0).alias("docs"))


def html_corpus(pages: DataFrame, html: str = "html", name: str = "visible") -> DataFrame:
    return pages.withColumn(name, T.html_to_text(F.col(html)))


def savings_by(rows: DataFrame, by: Sequence[Column | str], raw: str, compact: str) -> DataFrame:
    """Tokens before, after and saved per group."""
    t = rows.select(*by, T.est_tokens(F.col(raw)).cast("bigint").alias("raw"),
                    T.est_tokens(F.col(compact)).cast("bigint").alias("out"))
    names = [c for c in t.columns if c not in ("raw", "out")]
    g = t.groupBy(*names).agg(F.count("*").alias("runs"), F.sum("raw").alias("raw"),
                              F.sum("out").alias("out"))
    saved, pct = T.saved_columns(F.col("raw"), F.col("out"))
    return g.withColumns({"saved": saved, "pct": pct})


def binary_screen(docs: DataFrame, text: str = "text") -> DataFrame:
    """Flag unreadable texts; by the sniffing rule and by the whole text."""
    c = F.col(text)
    return docs.withColumns({
        "reason": T.binary_reason(c, P.BINARY_SAMPLE_CHARS),
        "whole_reason": T.binary_reason(c),
        "kb": T.kilobytes(c)})


def top_templates(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Most frequent line templates of the corpus (timestamps removed)."""
    lines = docs.select(F.explode(T.split_lines(F.col(text))).alias("line"))
    keys = lines.select(T.line_template(F.col("line")).alias("template")) \
        .where(T.strip(F.col("template")) != "")
    return keys.groupBy("template").agg(F.count("*").alias("n")) \
        .orderBy(F.col("n").desc(), "template").limit(k)


def clip_text(docs: DataFrame, text: str = "text", limit: int = P.MAX_LINE_CHARS) -> DataFrame:
    """Clip long lines; ``clipped_lines`` counts them."""
    lines = T.split_lines(F.col(text))
    return docs.withColumns({
        "clipped": T.join_lines(F.transform(lines, lambda x: T.clip_line(x, limit))),
        "clipped_lines": F.size(F.filter(lines, lambda x: F.length(x) > limit))})


def map_lines(docs: DataFrame, change, text: str = "text", name: str = "compact") -> DataFrame:
    """Apply a line-array operator to every text."""
    return docs.withColumn(name, T.join_lines(change(T.split_lines(F.col(text)))))


def split_path(rows: DataFrame, path: str = "path") -> DataFrame:
    c = F.col(path)
    return rows.withColumns({"dir": T.path_dir(c), "base": T.path_base(c), "ext": T.path_ext(c)})


def error_facts(docs: DataFrame, keys: Sequence[str], text: str = "text",
                context: int = 0) -> DataFrame:
    """Error lines per document as text and count."""
    kept = A.error_lines(T.split_lines(F.col(text)), context)
    return docs.select(*keys, kept.alias("_l")).select(
        *keys, F.size("_l").cast("bigint").alias("n_lines"), T.join_lines(F.col("_l")).alias("compact"))
