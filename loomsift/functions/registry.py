"""SQL names for the scalar expressions.

They are SQL functions, not Python functions: the optimizer inlines their
bodies, so a query that calls them runs in the JVM like one built from columns.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomsift import patterns as P
from loomsift.functions.text import GUARDED_ASSIGN


def _raw(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions and return their names."""
    entities = "t"
    for entity, char in P.HTML_ENTITIES:
        entities = f"replace({entities}, {_raw(entity)}, {_raw(char)})"
    markup = "s"
    for pattern, by in ((P.HTML_DROP_ELEMENT, " "), (P.HTML_COMMENT, " "), (P.HTML_LINE_END, "\\n"),
                        (P.HTML_TAG, " ")):
        markup = f"regexp_replace({markup}, {_raw(pattern)}, '{by}')"
    bom = "CASE" + "".join(f" WHEN startswith(s, '{b}') THEN substring(s, {len(b) + 1})" for b in P.BOMS) + " ELSE s END"
    space = "' \\t\\r\\n\\u000b\\u000c'"
    bodies = {
        "est_tokens": ("s STRING", "INT", "shiftright(length(s) + 3, 2)"),
        "strip_ansi": ("s STRING", "STRING", f"regexp_replace(s, {_raw(P.ANSI)}, '')"),
        "redact_secrets": ("s STRING", "STRING",
                           f"regexp_replace(regexp_replace(regexp_replace(s, {_raw(P.BEARER_VALUE)}, '$1{P.MASK}'), "
                           f"{_raw(GUARDED_ASSIGN)}, '$1$2{P.MASK}'), {_raw(P.SECRET_TOKEN)}, '{P.MASK}')"),
        "line_template": ("s STRING", "STRING", f"regexp_replace(s, {_raw(P.TIMESTAMP_PREFIX)}, '')"),
        "is_error_line": ("s STRING", "BOOLEAN", f"s RLIKE {_raw(P.ERROR_LINE)}"),
        "is_secret_key": ("s STRING", "BOOLEAN", f"s RLIKE {_raw(P.SECRET_KEY)}"),
        # The whole text decides, as in ``binary_reason``.
        "looks_binary": ("s STRING", "BOOLEAN",
                         f"contains(s, chr(0)) OR length(s) - length(regexp_replace(s, {_raw(P.CONTROL_CHARS)}, '')) > length(s) * {P.BINARY_CONTROL_SHARE} "
                         f"OR length(regexp_replace(s, {_raw(P.BASE64_RUN)}, '')) * 2 < length(s)"),
        "clean_control": ("s STRING", "STRING",
                          f"regexp_replace(replace(regexp_replace({bom}, {_raw(P.ANSI)}, ''), '\\r\\n', '\\n'), {_raw(P.REDRAWN)}, '')"),
        "html_to_text": ("s STRING", "STRING",
                         f"array_join(filter(transform(split(regexp_replace("
                         f"{entities.replace('(t,', '(' + markup + ',')}, '[ \\t]+', ' '), '\\n', -1), "
                         f"x -> btrim(x, {space})), x -> x <> ''), '\\n')"),
        "clip_line": ("s STRING", "STRING",
                      f"CASE WHEN length(s) > {P.MAX_LINE_CHARS} THEN concat(substring(s, 1, {P.MAX_LINE_CHARS}), "
                      f"' ...[+', length(s) - {P.MAX_LINE_CHARS}, ' chars]') ELSE s END"),
    }
    for name, (args, result, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(bodies)
