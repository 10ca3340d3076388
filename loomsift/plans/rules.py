"""Which compaction rule a captured command gets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: first word of a command -> rule ---------------------------
COMMAND_RULES = {
    "ls": "listing", "ll": "listing", "tree": "listing",
    "grep": "search", "rg": "search", "egrep": "search", "ag": "search",
    "find": "paths", "fd": "paths",
    "cat": "file", "read": "file",
    "git": "git",
    "terraform": "plan", "tofu": "plan",
    "docker": "container", "kubectl": "container", "k": "container",
    "helm": "container", "oc": "container", "podman": "container",
    "az": "cloud", "aws": "cloud", "gcloud": "cloud",
    "npm": "package", "pnpm": "package", "yarn": "package",
    "pip": "package", "pip3": "package",
    "eslint": "lint", "tsc": "lint", "ruff": "lint",
    "golangci-lint": "lint", "mypy": "lint",
    "journalctl": "journal",
    "systemctl": "units", "service": "units",
    "curl": "response", "wget": "response",
    "make": "build", "gradle": "build", "mvn": "build",
    "pytest": "test_report",
    "jest": "test", "vitest": "test", "mocha": "test", "rspec": "test", "phpunit": "test",
    "test": "test", "train": "train", "err": "errors", "json": "json",
    "summary": "generic", "proxy": "measure", "log": "log", "trim": "auto",
}
TWO_WORD_RULES = {
    ("cargo", "test"): "test", ("cargo", "build"): "test", ("cargo", "clippy"): "test",
    ("go", "test"): "test", ("go", "build"): "test",
    ("npm", "test"): "test", ("npm", "run"): "test",
    ("pnpm", "test"): "test", ("yarn", "test"): "test", ("dotnet", "test"): "test",
    ("mvn", "test"): "test", ("gradle", "test"): "test",
}


#: A user's rules are sent to every task up to so many distinct first words and pairs.
BROADCAST_RULES = 100_000


def builtin_rule(argv: Column) -> Column:
    """Built-in rule of a command as a constant lookup: two words beat one."""
    def table(rows: dict[str, str]) -> Column:
        return F.create_map(*(F.lit(x) for pair in rows.items() for x in pair))

    first, second = F.get(argv, F.lit(0)), F.get(argv, F.lit(1))
    pairs = table({f"{a} {b}": r for (a, b), r in TWO_WORD_RULES.items()})
    return F.coalesce(F.try_element_at(pairs, F.concat(first, F.lit(" "), second)), F.try_element_at(table(COMMAND_RULES), first))


def rule_lookup(captures: DataFrame, rules: DataFrame | None = None, argv: str = "argv",
                exclude: Sequence[str] = ()) -> DataFrame:
    """Add ``rule``; null means the text passes unchanged.

    The built-in rules need no join.  A user's table (word1, word2, rule) extends them
    and wins where both have the key; of rows with one key the smallest rule counts, so
    no capture is doubled.  Only the distinct words meet it; what they resolve to is
    broadcast if it is small, counted first, and joined otherwise.
    """
    a, b = F.get(F.col(argv), F.lit(0)), F.get(F.col(argv), F.lit(1))
    rule = builtin_rule(F.col(argv))
    out = captures
    if rules is not None:
        own = rules.where(F.col("word1").isNotNull()).groupBy("word1", "word2").agg(F.min("rule").alias("_own"))
        words = captures.select(a.alias("_a"), F.coalesce(b, F.lit("")).alias("_b")).where("_a IS NOT NULL").distinct()
        two = own.where("word2 IS NOT NULL").select(F.col("word1").alias("_a"), F.col("word2").alias("_b"), F.col("_own").alias("_two"))
        one = own.where("word2 IS NULL").select(F.col("word1").alias("_a"), F.col("_own").alias("_one"))
        resolved = (words.join(two, ["_a", "_b"], "left").join(one, "_a", "left")
                    .withColumn("_own2", F.col("_two")).withColumn("_own1", F.col("_one"))
                    .where(F.coalesce("_two", "_one").isNotNull()).select("_a", "_b", "_own2", "_own1"))
        small = resolved.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
        out = (captures.withColumn("_a", a).withColumn("_b", F.coalesce(b, F.lit("")))
               .join(F.broadcast(resolved) if small else resolved, ["_a", "_b"], "left").drop("_a", "_b"))
        pair = F.try_element_at(F.create_map(*(F.lit(x) for (p, q), r in TWO_WORD_RULES.items() for x in (f"{p} {q}", r))),
                                F.concat(a, F.lit(" "), b))
        rule = F.coalesce("_own2", pair, F.col("_own1"), rule)
    if exclude:
        rule = F.when(~a.isin(*exclude), rule)
    return out.withColumn("rule", rule).select(*captures.columns, "rule") if "rule" not in captures.columns else out.withColumn("rule", rule).drop("_own2", "_own1")


def cloud_rule(argv: Column) -> Column:
    """Payload kind of a cloud command, null when the generic profile applies."""
    def all_of(*words: str) -> Column:
        out = F.lit(True)
        for x in words:
            out = out & F.array_contains(argv, x)
        return out
    return (F.when(all_of("aks", "show"), "cluster")
            .when(all_of("sagemaker", "describe-training-job"), "job")
            .when(all_of("ml", "job", "show"), "job")
            .when(all_of("custom-jobs", "describe"), "job")
            .when(all_of("costmanagement") | all_of("consumption"), "cost")
            .when(all_of("apim", "list"), "api"))


def pattern_literals(pattern: Column) -> Column:
    """Distinct three-letter pieces that every match of a pattern contains; empty where none is sure.

    Patterns with groups, classes, escapes, alternatives or counts give none.
    """
    gap = F.lit("\n")
    p = F.regexp_replace(pattern, "[^+][*?]", "\n")
    p = F.regexp_replace(F.regexp_replace(p, "\\+", "\n"), "[.^$]", "\n")
    pieces = F.filter(F.split(p, gap), lambda x: F.length(x) >= 3)
    cut = F.flatten(F.transform(pieces, _trigrams))
    return F.when(F.rlike(pattern, F.lit("[|()\\[\\]{}\\\\\n]|[*?+][*?+]")), F.array().cast("array<string>")).otherwise(F.array_distinct(cut))


def _trigrams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda k: F.substr(text, k, F.lit(3)))


def _pattern_hits(names: DataFrame, patterns: DataFrame, constants: int) -> DataFrame:
    """Names (``_n``, distinct) that match one of many patterns (``_p``, distinct).

    A pattern meets only names that contain its rarest literal piece of three letters;
    one with a piece that no name has meets none.  Patterns without such a piece
    have nothing to be looked up by: up to ``constants`` of them are a filter, more meet
    all names.
    """
    from loomsift.operators.jsonops import allowed

    grams = names.where(F.length("_n") >= 3).select("_n", F.explode(F.array_distinct(_trigrams(F.col("_n")))).alias("_g"))
    counts = grams.groupBy("_g").agg(F.count("*").alias("_c"))
    keyed = patterns.withColumn("_l", pattern_literals(F.col("_p")))
    wanted = keyed.where(F.size("_l") > 0).select("_p", F.explode("_l").alias("_g")).join(counts, "_g", "left")
    rarest = wanted.groupBy("_p").agg(F.min_by("_g", F.coalesce("_c", F.lit(0))).alias("_g"))
    met = grams.join(rarest, (grams["_g"] == rarest["_g"]) & F.expr("_n RLIKE _p"), "left_semi").select("_n")
    loose = keyed.where(F.size("_l") == 0).select("_p")
    rows = loose.limit(constants + 1).collect()
    if len(rows) > constants:
        met = met.union(names.join(loose, F.expr("_n RLIKE _p"), "left_semi"))
    elif rows:
        met = met.union(names.where(allowed(F.col("_n"), sorted(r[0] for r in rows))))
    return met.distinct()


def pattern_semi_anti(names: DataFrame, column: str, include: DataFrame | None = None,
                      exclude: DataFrame | None = None, pattern: str = "pattern",
                      constants: int = 1000) -> DataFrame:
    """Rows that match any include pattern and no exclude pattern of a table.

    A table of at most ``constants`` patterns becomes constants of the filter.  A longer
    one is matched against the distinct names through pieces of three letters; either way
    the rows are the same, and an empty include table keeps none.
    """
    from loomsift.operators.jsonops import allowed

    out = names
    for table, keep in ((include, True), (exclude, False)):
        if table is None:
            continue
        some = table.select(F.col(pattern).alias("_p")).where("_p IS NOT NULL").distinct()
        rows = some.limit(constants + 1).collect()
        if len(rows) <= constants:
            found = sorted(r[0] for r in rows)
            if keep:
                out = out.where(allowed(F.col(column), found)) if found else out.where(F.lit(False))
            else:
                out = out.where(allowed(F.col(column), (), found))
        else:
            hits = _pattern_hits(out.select(F.col(column).alias("_n")).where("_n IS NOT NULL").distinct(), some, constants)
            out = out.join(hits, F.col(column) == F.col("_n"), "left_semi" if keep else "left_anti")
    return out
