"""Jobs over file tables: one row per file with ``path`` and ``text``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import text as T
from loomsift.operators.findings import skip_dirs
from loomsift.operators.lines import top_k_per_group


def is_code(path: Column) -> Column:
    return F.lower(T.path_ext(path)).isin(*P.CODE_EXTENSIONS)


def line_count(text: Column) -> Column:
    return F.size(T.split_lines(text))


def signature_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Signatures of code files under a header line; other files stay whole."""
    sig = F.filter(T.split_lines(F.col(text)), T.is_signature)
    header = F.concat(F.lit("# "), F.col(path), F.lit("  ("), line_count(F.col(text)).cast("string"),
                      F.lit(" lines -> "), F.size(sig).cast("string"), F.lit(" signatures)"))
    return files.withColumns({
        "n_lines": line_count(F.col(text)).cast("bigint"),
        "n_signatures": F.when(is_code(F.col(path)), F.size(sig)).cast("bigint"),
        "compact": F.when(is_code(F.col(path)), F.concat(header, F.lit("\n"), T.join_lines(sig)))
        .otherwise(F.col(text))})


def code_map(files: DataFrame, path: str = "path", text: str = "text",
             per_file: int = P.SIGNATURES_PER_FILE, plain: int = 12) -> DataFrame:
    """Map of a repository: directories, plain files, code files, signatures.

    One row per map line: ``dir``, ``kind`` (``dir`` / ``plain`` / ``more`` / ``code`` /
    ``signature``), ``name``, ``pos`` and ``n`` (files of a directory, plain files not
    shown, lines of a code file).  Imports and decorators are left out.
    """
    kept = skip_dirs(files, path)
    p = F.col(path)
    rows = kept.select(T.path_dir(p).alias("dir"), T.path_base(p).alias("name"), is_code(p).alias("code"),
                       F.col(text).alias("text"))
    dirs = rows.groupBy("dir").agg(F.count("*").alias("n")).select(
        "dir", F.lit("dir").alias("kind"), F.lit("").alias("name"), F.lit("").alias("line"),
        F.lit(0).cast("bigint").alias("pos"), "n")
    others = top_k_per_group(rows.where(~F.col("code")).select("dir", "name"), ["dir"], ["name"], plain).select(
        "dir", F.lit("plain").alias("kind"), "name", F.lit("").alias("line"),
        F.col("rank").cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("n"))
    # What the cut leaves out is counted.
    more = rows.where(~F.col("code")).groupBy("dir").agg((F.count("*") - plain).alias("n")).where("n > 0").select(
        "dir", F.lit("more").alias("kind"), F.lit("").alias("name"), F.lit("").alias("line"), F.lit(plain + 1).cast("bigint").alias("pos"), "n")
    code = rows.where("code")
    heads = code.select("dir", F.lit("code").alias("kind"), "name", F.lit("").alias("line"),
                        F.lit(0).cast("bigint").alias("pos"), line_count(F.col("text")).cast("bigint").alias("n"))
    sigs = F.transform(F.filter(T.split_lines(F.col("text")), T.is_signature), lambda x: T.strip(x))
    own = F.filter(sigs, lambda s: ~(F.startswith(s, F.lit("import ")) | F.startswith(s, F.lit("from "))
                                     | F.startswith(s, F.lit("@"))))
    lines = code.select("dir", "name", F.posexplode(F.slice(own, 1, per_file)).alias("i", "s")).select(
        "dir", F.lit("signature").alias("kind"), "name", F.substring("s", 1, 120).alias("line"),
        (F.col("i") + 1).cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("n"))
    return dirs.unionByName(others).unionByName(more).unionByName(heads).unionByName(lines)


def view_file(files: DataFrame, lines: int, text: str = "text") -> DataFrame:
    """Head and tail of every file."""
    from loomsift.functions import linearrays as A

    return files.withColumn("compact", T.join_lines(A.head_tail(T.split_lines(F.col(text)), lines)))


def ordered_parts(parts: DataFrame, key: Sequence[str], order: str, text: str, k: int) -> DataFrame:
    """Concatenate at most ``k`` ordered parts per key (summary lines)."""
    first = top_k_per_group(parts, key, [order], k, "_rank")
    return first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(F.col("_rank"), F.col(text).alias("part")))), lambda s: s["part"]), "\n").alias("compact"))
