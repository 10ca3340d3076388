"""Training curves, null profiles and classification reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions import linearrays as A
from loomsift.functions import text as T
from loomsift.functions.text import let


def _line_metrics(line: Column) -> Column:
    """(metric, value) pairs of one log line, in order."""
    def side(m: Column, i: int) -> Column:
        return F.when(F.contains(m, F.lit("=")), F.substring_index(m, "=", i)).otherwise(F.substring_index(m, ":", i))

    # The line is searched once; a match is cut apart without another search of the line.
    named = F.transform(F.regexp_extract_all(line, F.lit(P.METRIC_ONCE), F.lit(0)), lambda m: F.struct(
        F.lower(F.rtrim(side(m, 1), F.lit(P.WHITESPACE))).alias("metric"), m.alias("m")))
    pairs = F.transform(F.filter(named, lambda p: ~p["metric"].isin(*P.METRIC_SKIP)), lambda p: F.struct(
        p["metric"].alias("metric"), side(p["m"], -1).try_cast("double").alias("value")))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def _is_mark(line: Column) -> Column:
    # Byte searches settle most lines, here and in ``training_epochs``.
    return F.contains(line, F.lit("/")) & line.rlike(P.EPOCH_MARK)


def training_epochs(text: Column) -> Column:
    """Array of epochs, each an array of (metric, value) in log order.

    Epochs begin at ``Epoch i/n`` lines; without any such line every line with a
    loss is an epoch.  Epochs without metrics do not count.
    """
    pair = "array<struct<metric:string,value:double>>"

    def build(lines: Column) -> Column:
        def from_lines(rows: Column) -> Column:
            def cut(heads: Column) -> Column:
                def between(start: Column, end: Column) -> Column:
                    return F.flatten(F.slice(rows, start + 1, end - start))
                # What stands before the first mark counts too.
                first = between(F.lit(0), F.get(heads, F.lit(0)))
                rest = F.transform(heads, lambda h, j: between(h, F.coalesce(F.get(heads, j + 1), F.size(rows))))
                per_line = F.filter(rows, lambda m: F.exists(m, lambda p: F.contains(p["metric"], F.lit("loss"))))
                return F.filter(F.when(F.size(heads) > 0, F.concat(F.array(first), rest)).otherwise(per_line),
                                lambda e: F.size(e) > 0)
            return let(F.filter(A.positions(lines), lambda i: _is_mark(F.get(lines, i))), cut)
        none = F.array().cast(pair)
        return let(F.transform(lines, lambda x: F.when(
            F.contains(x, F.lit(":")) | F.contains(x, F.lit("=")), _line_metrics(x)).otherwise(none)), from_lines)
    return let(T.split_lines(text), build).cast(f"array<{pair}>")


def _last_values(pairs: Column) -> Column:
    """Of every metric of an epoch the last value."""
    def pick(names: Column) -> Column:
        # One pass for each of the few metric names.
        return F.when(F.size(names) == F.size(pairs), pairs).otherwise(F.transform(names, lambda m: F.element_at(
            F.filter(pairs, lambda p: p["metric"] == m), -1)))
    return let(F.array_distinct(F.transform(pairs, lambda p: p["metric"])), pick)


def training_facts(runs: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    """Metric series in long form: (keys, epoch from 1, metric, value).

    When a metric is logged several times in an epoch the last value counts.
    """
    e = runs.select(*keys, F.posexplode(training_epochs(F.col(text))).alias("epoch", "pairs"))
    return e.select(*keys, (F.col("epoch") + 1).cast("bigint").alias("epoch"), F.inline(_last_values(F.col("pairs"))))


def training_series(runs: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    """One row per run and metric: ``series_summary`` of its ``training_facts``.

    A run holds its whole series, so every summary is made in its row, without an exchange.
    """
    entries = F.flatten(F.transform(training_epochs(F.col(text)), lambda e, i: F.transform(_last_values(e), lambda p: F.struct(
        p["metric"].alias("k"), (i + 1).cast("bigint").alias("at"), p["value"].alias("v")))))

    def summary(g: Column) -> Column:
        rows = g["members"]
        best = F.array_min(F.transform(rows, lambda r: F.struct(r["v"].alias("v"), r["at"].alias("e"))))

        def with_best(b: Column) -> Column:
            n, end = F.size(rows).cast("bigint"), F.element_at(rows, -1)
            since = end["at"] - b["e"]
            return F.struct(g["k"].alias("metric"), n.alias("epochs"), F.element_at(rows, 1)["v"].alias("first"), end["v"].alias("last"),
                            b["v"].alias("best"), b["e"].alias("best_epoch"), since.alias("since_best"),
                            (since >= F.greatest(F.lit(5), F.floor(n / 10))).alias("plateau"))
        return let(best, with_best)
    return runs.select(*keys, F.inline(F.transform(A.grouped(entries), summary)))


def series_summary(series: DataFrame, by: Sequence[str], epoch: str = "epoch",
                   value: str = "value", better: str = "min") -> DataFrame:
    """First, last and best value of every series, and epochs since the best.

    Ties go to the earliest epoch.  All aggregates are partial, so a series of
    any length and share of the table needs no window.  ``epoch`` must count
    from 1 without gaps for ``since_best`` and ``plateau``.
    """
    v, at = F.col(value), F.col(epoch)
    best = F.min(F.struct((v if better == "min" else -v).alias("k"), at.alias("e"), v.alias("v")))
    agg = series.groupBy(*by).agg(
        F.count("*").alias("epochs"), F.min_by(v, at).alias("first"), F.max_by(v, at).alias("last"),
        best.alias("_b"), F.max(at).alias("_end"))
    since = F.col("_end") - F.col("_b")["e"]
    return agg.select(*by, "epochs", "first", "last", F.col("_b")["v"].alias("best"),
                      F.col("_b")["e"].alias("best_epoch"), since.alias("since_best"),
                      (since >= F.greatest(F.lit(5), F.floor(F.col("epochs") / 10))).alias("plateau"))


def training_curve(text: Column) -> Column:
    """Summary struct of one training log, null for fewer than two epochs.

    (epochs, metrics: array of (metric, first, last) of every metric, best_metric,
    best_epoch, best_value, since_best, plateau)
    """
    def build(text: Column, epochs: Column) -> Column:
        def value_in(e: Column, metric: Column) -> Column:
            return F.try_element_at(F.filter(e, lambda p: p["metric"] == metric), F.lit(-1))["value"]

        def series(metric: Column) -> Column:
            return F.filter(F.transform(epochs, lambda e, i: F.struct(
                value_in(e, metric).alias("v"), i.alias("i"))), lambda s: s["v"].isNotNull())

        seen = F.array_distinct(F.transform(F.flatten(epochs), lambda p: p["metric"]))
        order = F.array(*[F.lit(m) for m in P.METRIC_ORDER])

        def with_metrics(names: Column) -> Column:
            chosen = F.concat(F.filter(order, lambda m: F.array_contains(names, m)),
                              F.filter(names, lambda m: ~F.array_contains(order, m)))
            ranges = F.transform(chosen, lambda m: let(series(m), lambda s: F.struct(
                m.alias("metric"), F.get(s, F.lit(0))["v"].alias("first"),
                F.get(s, F.size(s) - 1)["v"].alias("last"))))
            totals = F.transform(F.filter(T.split_lines(text), _is_mark), lambda x: F.regexp_extract(x, P.EPOCH_MARK, 2).try_cast("int"))
            n = F.coalesce(F.nullif(F.array_max(totals), F.lit(0)), F.size(epochs))

            def best_of(metric: str, better: str) -> Column:
                sign = 1.0 if better == "min" else -1.0
                ranked = F.transform(series(F.lit(metric)), lambda s: F.struct(
                    (s["v"] * sign).alias("k"), s["i"].alias("i"), s["v"].alias("v")))
                return F.struct(F.lit(metric).alias("metric"), F.array_min(ranked).alias("b"))

            best = reduce(lambda acc, mb: F.when(F.array_contains(names, F.lit(mb[0])), best_of(*mb)).otherwise(acc),
                          reversed(P.BEST_METRIC_ORDER),
                          F.lit(None).cast("struct<metric:string,b:struct<k:double,i:int,v:double>>"))

            def with_best(b: Column, n: Column) -> Column:
                since = F.size(epochs) - 1 - b["b"]["i"]
                return F.struct(n.alias("epochs"), ranges.alias("metrics"), b["metric"].alias("best_metric"),
                                (b["b"]["i"] + 1).alias("best_epoch"), b["b"]["v"].alias("best_value"),
                                since.alias("since_best"),
                                (since >= F.greatest(F.lit(5), F.floor(n / 10))).alias("plateau"))
            return let(best, lambda b: let(n, lambda total: with_best(b, total)))
        return F.when(F.size(epochs) >= 2, let(seen, with_metrics))
    return let(text, lambda t: let(training_epochs(t), lambda epochs: build(t, epochs)))


def compact_training(text: Column) -> Column:
    def num(v: Column) -> Column:
        # Four significant digits, without trailing zeros.
        return F.regexp_replace(F.format_string("%.3e", v).cast("double").cast("string"), r"\.0$", "")

    def render(c: Column) -> Column:
        ranges = F.array_join(F.transform(F.slice(c["metrics"], 1, P.METRICS_SHOWN), lambda m: F.concat(
            m["metric"], F.lit(" "), num(m["first"]), F.lit("->"), num(m["last"]))), ", ")
        best = F.concat(F.lit("\nBest: epoch "), c["best_epoch"].cast("string"), F.lit(" "), c["best_metric"],
                        F.lit("="), num(c["best_value"]),
                        F.when(c["plateau"], F.concat(F.lit(" | No improvement last "),
                                                      c["since_best"].cast("string"),
                                                      F.lit(" epochs (early-stop candidate)")))
                        .otherwise(F.lit("")))
        return F.concat(F.lit("Training "), c["epochs"].cast("string"), F.lit(" epochs ("), ranges, F.lit(")"),
                        F.when(c["best_metric"].isNotNull(), best).otherwise(F.lit("")))
    return let(training_curve(text), render)


# --- data frames -------------------------------------------------------------

def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls and whether over 25 % are null."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                                 F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"))
                        for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.inline(entries)).withColumn(
        "flag", F.col("nulls") > F.col("rows") * P.NULL_FLAG_SHARE)


def dtype_counts(df: DataFrame) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(t,) for _, t in df.dtypes], "dtype string")
    return rows.groupBy("dtype").agg(F.count("*").alias("columns"))


def class_metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, f1 and support per class.

    The table is read once; only (label, prediction) counts go on.
    """
    pairs = rows.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select("n", F.explode(F.array(
        F.struct(F.col("l").cast("string").alias("class"), F.lit(True).alias("is_label")),
        F.struct(F.col("p").cast("string").alias("class"), F.lit(False).alias("is_label")))).alias("s"),
        (F.col("l") == F.col("p")).alias("hit"))
    agg = sides.groupBy(F.col("s.class").alias("class")).agg(
        F.coalesce(F.sum(F.when(F.col("s.is_label"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("s.is_label"), F.col("n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when(F.col("s.is_label") & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"))
    zero = F.lit(0.0)
    out = agg.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), zero)) \
        .withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), zero)
    return out.withColumn("f1", f1).drop("predicted")


def class_report(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, macro and weighted f1 and the class of worst recall."""
    m = class_metrics(rows, label, prediction)
    worst = F.min(F.struct("recall", "class", "f1"))
    return m.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.sum("support").alias("n"),
                 F.avg("f1").alias("macro_f1"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
                 worst.alias("w")).select(
        "accuracy", "n", "macro_f1", "weighted_f1", F.col("w.class").alias("worst_class"),
        F.col("w.recall").alias("worst_recall"), F.col("w.f1").alias("worst_f1"))
