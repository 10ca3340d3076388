"""Registry of queries, derived inputs shared with the SQL check, SQL pieces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomsift import patterns as P
from loomsift.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, the statement to compare with."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def read(spark: SparkSession, sf_dir: str, table: str, wide: bool = False) -> DataFrame:
    """A given table; ``wide`` spreads small files over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    # Rows of orders and customers are narrow, the texts built from them are not.
    return spread(df, 8 if table in ("orders", "customer") else 1) if wide else df


@dataclass(frozen=True)
class Derived:
    """A projection of a given table, written in SQL both engines read."""

    table: str
    exprs: tuple[str, ...]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # Texts are built and compacted in place: worth a core for every share.
        return read(spark, sf_dir, self.table, wide=self.table != "events").selectExpr(*self.exprs)

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.exprs)} FROM {self.table})"


def text_of(*lines: str) -> str:
    """SQL expression of a text with the given line expressions."""
    return " || chr(10) || ".join(lines)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- SQL pieces of the check -------------------------------------------------

def lines_of(rel: str, keys: str, text: str) -> str:
    """(keys, n from 1, line)"""
    return (f"(SELECT {keys}, unnest(string_split({text}, chr(10))) AS line, "
            f"unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS n FROM {rel})")


def clip(line: str, limit: int = P.MAX_LINE_CHARS) -> str:
    return (f"CASE WHEN length({line}) > {limit} THEN substr({line}, 1, {limit}) || ' ...[+' || "
            f"(length({line}) - {limit}) || ' chars]' ELSE {line} END")


def head_tail(rel: str, keys: str, limit: int, order: str = "n") -> str:
    """(keys, compact) of a line relation."""
    head = limit * 2 // 3
    tail = limit - head
    return (f"(SELECT {keys}, string_agg(CASE WHEN c > {limit} AND r = {head + 1} THEN '... [' || (c - {limit}) || "
            f"' lines omitted] ...' ELSE {clip('line')} END, chr(10) ORDER BY r) AS compact FROM ("
            f"SELECT {keys}, line, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r, "
            f"count(*) OVER (PARTITION BY {keys}) AS c FROM {rel}) "
            f"WHERE c <= {limit} OR r <= {head + 1} OR r > c - {tail} GROUP BY {keys})")


def joined(rel: str, keys: str, order: str = "n", name: str = "compact") -> str:
    return f"(SELECT {keys}, string_agg(line, chr(10) ORDER BY {order}) AS {name} FROM {rel} GROUP BY {keys})"


def islands(rel: str, keys: str, order: str, key: str = "line", blank_breaks: bool = False,
            extra: str = "") -> str:
    """(keys, isl, first order value(s) n, line, k, c): runs of equal keys."""
    blank = f" OR trim({key}, {WS}) = ''" if blank_breaks else ""
    return (f"(SELECT {keys}, isl, min(pos) AS pos, arg_min(line, pos) AS line, any_value(k) AS k, count(*) AS c"
            f"{extra} FROM (SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY pos) AS isl FROM ("
            f"SELECT *, {key} AS k, CASE WHEN lag({key}) OVER (PARTITION BY {keys} ORDER BY pos) = {key} "
            f"AND NOT (false{blank}) THEN 0 ELSE 1 END AS f FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS pos FROM {rel}))) "
            f"GROUP BY {keys}, isl)")


def dedup_lines(rel: str, keys: str, order: str = "n", key: str = "line") -> str:
    """(keys, n, line) with runs marked."""
    return (f"(SELECT {keys}, pos AS n, CASE WHEN c > 1 THEN line || '  (x' || c || ')' ELSE line END AS line "
            f"FROM {islands(rel, keys, order, key)})")


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def template(line: str) -> str:
    return f"regexp_replace({line}, {lit(P.TIMESTAMP_PREFIX)}, '')"


def smart_lines(rel: str, keys: str, order: str = "n", key: str | None = None,
                extra_cols: str = "") -> str:
    """(keys, n, line) after collapsing repeats by template."""
    key = key or template("line")
    runs = islands(rel, keys, order, key, blank_breaks=True)
    kl = ", ".join(f"{k.strip()}" for k in keys.split(","))
    return (f"(SELECT {keys}, pos AS n, CASE WHEN b THEN line WHEN rec THEN line || '  (x' || tot || ' total)' "
            f"WHEN c > 1 THEN line || '  (x' || c || ')' ELSE line END AS line, "
            f"CASE WHEN NOT b AND rec THEN tot ELSE c END AS cnt FROM ("
            f"SELECT *, trim(k, {WS}) = '' AS b, sum(c) OVER (PARTITION BY {kl}, k) AS tot, "
            f"sum(c) OVER (PARTITION BY {kl}, k) >= {P.SMART_DEDUP_MIN_TOTAL} "
            f"AND sum(c) OVER (PARTITION BY {kl}, k) > c AS rec, "
            f"row_number() OVER (PARTITION BY {kl}, k ORDER BY pos) AS occ FROM {runs}) "
            f"WHERE b OR NOT rec OR occ = 1)")


def drop_progress(rel: str) -> str:
    s = f"trim(line, {WS})"
    return (f"(SELECT * FROM {rel} WHERE {s} = '' OR NOT (regexp_matches({s}, {lit(P.PROGRESS_PERCENT)}) "
            f"OR regexp_matches({s}, {lit(P.PROGRESS_VERB)})) OR {is_error('line')})")


def is_error(line: str) -> str:
    return f"regexp_matches({line}, {lit(P.ERROR_LINE)})"


def error_context(rel: str, keys: str, k: int, order: str = "n") -> str:
    """Lines near an error, same columns."""
    return (f"(SELECT * EXCLUDE (near) FROM (SELECT *, max(CASE WHEN {is_error('line')} THEN 1 ELSE 0 END) OVER ("
            f"PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS near "
            f"FROM {rel}) WHERE near = 1)")


def redact(text: str) -> str:
    return (f"regexp_replace(regexp_replace({text}, {lit(P.SECRET_ASSIGN)}, '\\1\\2{P.MASK}', 'g'), "
            f"{lit(P.SECRET_TOKEN)}, '{P.MASK}', 'g')")


def tokens(text: str) -> str:
    return f"((length({text}) + 3) // 4)"


def html_text(html: str) -> str:
    t = html
    for tag in ("script", "style", "svg", "head", "noscript"):
        # RE2 has no back references: one pattern per dropped element.
        t = f"regexp_replace({t}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    t = f"regexp_replace({t}, {lit(P.HTML_COMMENT)}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(P.HTML_LINE_END)}, chr(10), 'g')"
    t = f"regexp_replace({t}, {lit(P.HTML_TAG)}, ' ', 'g')"
    for e, c in P.HTML_ENTITIES:
        t = f"replace({t}, {lit(e)}, {lit(c)})"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), "
            f"lambda x: trim(x, {WS})), lambda x: x <> ''), chr(10))")


def without_blobs(text: str) -> str:
    return f"regexp_replace({text}, '[A-Za-z0-9+/=]{{400,}}', '{P.BLOB_NOTE}', 'g')"


def binary_reason(text: str, sample: int | None) -> str:
    s = f"substr({text}, 1, {sample})" if sample else text
    control = f"(length({s}) - length(regexp_replace({s}, '[\\x00-\\x08\\x0e-\\x1f]', '', 'g')))"
    run = (f"regexp_matches({s}, '[A-Za-z0-9+/=]{{400,}}')" if sample
           else f"length(regexp_replace({s}, '[A-Za-z0-9+/=]{{400,}}', '', 'g')) * 2 < length({s})")
    return (f"CASE WHEN contains({s}, chr(0)) THEN 'nul' WHEN {control} > length({s}) * 0.05 THEN 'control' "
            f"WHEN {run} THEN 'base64' END")


def host(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/]+)', 1)"
