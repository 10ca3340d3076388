"""Jobs over tables of JSON documents, on the VARIANT type."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift import patterns as P
from loomsift.functions.text import is_secret_key, let, strip, strip_bom
from loomsift.session import shared_dir


def parse_json(text: Column) -> Column:
    """VARIANT of a JSON text, null when the text is not JSON."""
    return F.try_parse_json(strip(strip_bom(text)))


def read_json_docs(docs: DataFrame, text: str = "text", name: str = "json") -> DataFrame:
    """Add the parsed value; rows that are not JSON keep a null."""
    return docs.withColumn(name, parse_json(F.col(text)))


ROWS = "array<struct<path:string,type:string,sample:string,n_items:bigint,redacted:boolean>>"


class _Number(str):
    """A number as it is written."""

    __slots__ = ()


def _opened(text: str, mask: bool) -> list[tuple] | None:
    """Rows of one text (see ``json_rows``), numbers as written; null when it is not JSON."""
    if text.startswith(P.BOMS):
        text = text[len(next(b for b in P.BOMS if text.startswith(b))):]
    try:
        root = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
    except RecursionError:
        return [("$", "deeper", "{...}", None, False)]
    except ValueError:
        return None
    return _walked("$", root, False, 0, re.compile(P.SECRET_KEY).search if mask else lambda key: None)


def _walked(start: str, root: object, masked: bool, depth: int, secret: Callable) -> list[tuple]:
    """Rows of a parsed value that stands ``depth`` levels deep."""
    rows: list[tuple] = []
    level: list[tuple] = [(start, root, masked)]
    while level:
        below: list[tuple] = []
        for path, value, hidden in level:
            inside: list[tuple] = []
            if hidden:
                rows.append((path, "redacted", P.MASK, None, True))
            elif isinstance(value, dict):
                inside = [(f"{path}.{k}", v, bool(secret(k))) for k, v in value.items()] if depth < P.JSON_LEVELS else []
                rows.append((path, "deeper", "{...}", None, False) if value and not inside else (path, "object", None if value else "{}", None, False))
            elif isinstance(value, list):
                inside = [(f"{path}[]", value[0], False)] if value and depth < P.JSON_LEVELS else []
                rows.append((path, "deeper", "[...]", None, False) if value and not inside else (path, "array", None, len(value), False))
            elif isinstance(value, _Number):
                rows.append((path, "number", str(value), None, False))
            elif isinstance(value, str):
                rows.append((path, "string", value if len(value) <= P.JSON_STRING_CHARS else value[:P.JSON_STRING_CHARS - 3] + "...", None, False))
            elif value is None:
                rows.append((path, "null", None, None, False))
            else:
                rows.append((path, "boolean", "true" if value else "false", None, False))
            below += inside
        level, depth = below, depth + 1
    return rows


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _utf8(value: str | None) -> bytes | None:
    """Lone surrogates, which an escape can spell, become question marks."""
    return None if value is None else value.encode("utf-8", "replace")


def _opener(mask: bool):
    @F.arrow_udf(ROWS)
    def opened(texts: pa.Array) -> pa.Array:
        flat: list[tuple] = []
        ends, known = [0], []
        for text in texts:
            rows = None if text.as_py() is None else _opened(text.as_py(), mask)
            known.append(rows is None)
            flat += rows or []
            ends.append(len(flat))
        path, kind, sample, n, hidden = zip(*flat) if flat else ((),) * 5
        strings = [pa.array(map(_utf8, c), pa.binary(), size=len(flat)).cast(pa.string()) for c in (path, kind, sample)]
        items = pa.StructArray.from_arrays([*strings, pa.array(n, pa.int64()), pa.array(hidden, pa.bool_())], names=["path", "type", "sample", "n_items", "redacted"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array(known, pa.bool_()))
    return opened


def json_rows(text: Column, mask: bool = True) -> Column:
    """Structure of a JSON text as an array of rows; null when the text is not JSON.

    A row has ``path``, ``type``, ``sample`` (strings over 60 characters are clipped,
    values of secret-looking keys masked, ``{}`` for an empty object), ``n_items``
    (lists) and ``redacted``.  Lists show their first element; of a repeated key the last
    value counts.

    One walk over the document, in an Arrow batch: a node costs its own size and path,
    whatever else the document holds.  What lies beyond ``JSON_LEVELS`` levels is named by
    a row of type ``deeper`` and not shown; of a text nested deeper than the parser goes
    that row is the only one.
    """
    return F.transform(_opener(mask)(text), _shown)


def _shown(r: Column) -> Column:
    # Numbers as the engine writes them, one small value at a time.
    number = F.coalesce(F.try_parse_json(r["sample"]).cast("string"), r["sample"])
    return F.struct(r["path"].alias("path"), r["type"].alias("type"), F.when(r["type"] == "number", number).otherwise(r["sample"]).alias("sample"),
                    r["n_items"].alias("n_items"), r["redacted"].alias("redacted"))


def _has_line(r: Column) -> Column:
    return r["sample"].isNotNull() | r["n_items"].isNotNull() | (r["type"] == "null")


def _line(r: Column) -> Column:
    return F.concat(r["path"], F.lit("="), F.coalesce(r["sample"], F.concat(F.lit("("), r["n_items"].cast("string"), F.lit(" items)")), F.lit("null")))


def json_lines(rows: Column) -> Column:
    """Ordered ``path=sample`` lines of the rows of a document; objects show through their members."""
    return F.array_join(F.array_sort(F.transform(F.filter(rows, _has_line), _line)), "\n")


def compact_json(text: Column, mask: bool = True) -> Column:
    """``compact`` and ``redacted`` of a JSON text in one struct; null when it is not JSON."""
    return let(json_rows(text, mask), lambda rows: F.when(rows.isNotNull(), F.struct(
        json_lines(rows).alias("compact"), F.exists(rows, lambda r: r["redacted"]).alias("redacted"))))


def _members(text: str) -> Iterator[tuple[str, object]]:
    """Top-level members of the text of an object, one at a time; of a repeated key the last.

    A first pass keeps eight bytes a member, to know repeated keys; nothing else is held.
    """
    decode = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_no_constant).raw_decode
    gap = re.compile(r"[ \t\n\r]*").match

    def scan() -> Iterator[tuple[str, object]]:
        at = gap(text, gap(text).end() + 1).end()
        more = text[at:at + 1] != "}"
        while more:
            if text[at:at + 1] != '"':
                raise ValueError("a key is missing")
            key, at = decode(text, at)
            at = gap(text, at).end()
            if text[at:at + 1] != ":":
                raise ValueError("a value is missing")
            value, at = decode(text, gap(text, at + 1).end())
            yield key, value
            at = gap(text, at).end()
            more = text[at:at + 1] == ","
            at = gap(text, at + 1).end() if more else at
        if text[at:at + 1] != "}" or gap(text, at + 1).end() != len(text):
            raise ValueError("the object does not end")

    hashes = np.fromiter((hash(k) for k, _ in scan()), np.int64)
    distinct, counts = np.unique(hashes, return_counts=True)
    twice = set(distinct[counts > 1].tolist())
    last = {k: i for i, (k, _) in enumerate(scan()) if hash(k) in twice} if twice else {}
    return ((k, v) for i, (k, v) in enumerate(scan()) if last.get(k, i) == i)


def _wide_rows(text: str) -> Iterator[tuple]:
    """The rows of ``_opened`` in another order, member by member; none when the text is not JSON."""
    text = text[len(next((b for b in P.BOMS if text.startswith(b)), "")):]
    if text.lstrip(" \t\n\r")[:1] != "{":
        yield from _opened(text, True) or []
        return
    secret = re.compile(P.SECRET_KEY).search
    try:
        members, empty = _members(text), True
        for key, value in members:
            empty = False
            yield from _walked(f"$.{key}", value, bool(secret(key)), 1, secret)
        yield "$", "object", "{}" if empty else None, None, False
    except RecursionError:
        yield "$", "deeper", "{...}", None, False
    except ValueError:
        return


def json_compact_wide(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``json_compact`` for documents of millions of members: no task holds an opened document.

    Texts are read member by member, the lines are written once to the shared folder, sorted by
    ranges and put together range by range.  Only a document's text and result are whole, and a
    row of Spark holds 2 GB at most.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                rows = iter(_wide_rows(body.as_py()))
                while part := list(islice(rows, 50_000)):
                    columns = list(zip(*part))
                    strings = [pa.array(map(_utf8, c), pa.binary(), size=len(part)).cast(pa.string()) for c in columns[:3]]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part), batch.schema.field(0).type), *strings, pa.array(columns[3], pa.int64()),
                                                      pa.array(columns[4], pa.bool_())], names=["k", "path", "type", "sample", "n_items", "redacted"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInArrow(
        opened, f"k {kind}, path string, type string, sample string, n_items bigint, redacted boolean")
    row = F.struct("path", "type", "sample", "n_items", "redacted")
    path = shared_dir(spark, "json-wide")
    rows.select("k", _line(_shown(row)).alias("line"), _has_line(row).alias("shows")).write.parquet(path)
    lines = spark.read.parquet(path)
    parts = lines.where("shows").repartitionByRange("k", "line").withColumn("part", F.spark_partition_id()) \
        .groupBy("k", "part").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("chunk"))
    whole = parts.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk"))), lambda x: x["chunk"]), "\n").alias("compact"))
    # A document whose rows show nothing has an empty text.
    return lines.select("k").distinct().join(whole, "k", "left").select(F.col("k").alias(key), F.coalesce("compact", F.lit("")).alias("compact"))


def json_profile(docs: DataFrame, keys: Sequence[str], text: str = "text", mask: bool = True) -> DataFrame:
    """Structure of every JSON document, one row per path (see ``json_rows``), next to ``keys``."""
    return docs.select(*keys, F.inline(json_rows(F.col(text), mask)))


def corpus_profile(profile: DataFrame, key: str) -> DataFrame:
    """One row per path of the corpus: documents, types, longest list."""
    return profile.groupBy("path").agg(
        F.count("*").alias("docs"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.max("n_items").alias("max_items"),
        F.count_if("redacted").alias("redacted"))


def json_compact(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and the ``path=sample`` lines of every row that holds a JSON document.

    A filter on the lines would be moved down to the scan and open every document there a
    second time, on as many cores as the scan has splits; a generator stays where it is.
    """
    return docs.select(key, F.explode(F.filter(F.array(compact_json(F.col(text))["compact"]), lambda c: c.isNotNull())).alias("compact"))


def secret_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """Inventory of secret-looking keys at every level with their counts.

    What stands below a secret key is not looked into; of a list the first element is.
    """
    rows = docs.select(F.explode(F.filter(json_rows(F.col(text)), lambda r: r["redacted"])).alias("r"))
    return rows.select(F.element_at(F.split("r.path", r"\."), -1).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


# --- typed payloads ----------------------------------------------------------

def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: str, path: str) -> Column:
    return F.coalesce(_get(v, path), F.lit("?"))


def cluster_rows(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Managed-cluster payloads, one row per payload and node pool."""
    v = docs.select(*keys, parse_json(F.col(text)).alias("v")).where(F.col("v").isNotNull())
    flat = v.select(
        *keys, _text("v", "$.name").alias("name"), _text("v", "$.location").alias("location"),
        _text("v", "$.kubernetesVersion").alias("version"),
        _text("v", "$.provisioningState").alias("state"),
        _text("v", "$.powerState.code").alias("power"),
        _text("v", "$.identity.type").alias("identity"),
        F.coalesce(_get("v", "$.aadProfile.managed", "boolean"), F.lit(False)).alias("managed_aad"),
        _text("v", "$.networkProfile.networkPlugin").alias("network_plugin"),
        F.try_variant_get("v", "$.tags", "map<string,string>").alias("tags"),
        F.explode_outer(F.try_variant_get("v", "$.agentPoolProfiles", "array<variant>")).alias("p"))
    return flat.select(
        *keys, "name", "location", "version", "state", "power", "identity", "managed_aad",
        "network_plugin", "tags", F.when(F.col("p").isNotNull(), _text("p", "$.name")).alias("pool"),
        _get("p", "$.count", "bigint").alias("nodes"),
        F.when(F.col("p").isNotNull(), F.regexp_replace(_text("p", "$.vmSize"), "Standard_", ""))
        .alias("vm_size"),
        F.when(F.col("p").isNotNull(), _text("p", "$.osType")).alias("os"),
        F.when(F.col("p").isNotNull(), _text("p", "$.mode")).alias("mode"))


def job_rows(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Training-job payloads of three services, one row per payload.

    ``metrics`` and ``params`` are maps; ``billable`` is in seconds.
    """
    v = docs.select(*keys, parse_json(F.col(text)).alias("v")).where(F.col("v").isNotNull())
    listed = F.try_variant_get("v", "$.FinalMetricDataList",
                               "array<struct<MetricName:string,Value:double>>")
    metric_map = F.try_variant_get("v", "$.metrics", "map<string,double>")
    is_a = _get("v", "$.TrainingJobName").isNotNull()
    is_c = _get("v", "$.jobSpec").isNotNull()
    return v.select(
        *keys,
        F.when(is_a, "sagemaker").when(is_c, "vertex").otherwise("azureml").alias("service"),
        F.coalesce(_get("v", "$.TrainingJobName"), _get("v", "$.display_name"),
                   _get("v", "$.displayName"), _get("v", "$.name"), F.lit("?")).alias("name"),
        F.coalesce(_get("v", "$.TrainingJobStatus"), _get("v", "$.status"),
                   _get("v", "$.state"), F.lit("?")).alias("status"),
        F.coalesce(_get("v", "$.ResourceConfig.InstanceType"), _get("v", "$.compute"),
                   _get("v", "$.resources.instance_type"),
                   _get("v", "$.jobSpec.workerPoolSpecs[0].machineSpec.machineType"),
                   F.lit("?")).alias("machine"),
        _get("v", "$.BillableTimeInSeconds", "bigint").alias("billable"),
        F.coalesce(metric_map, F.map_from_entries(F.transform(
            F.coalesce(listed, F.array().cast("array<struct<MetricName:string,Value:double>>")),
            lambda m: F.struct(F.coalesce(m["MetricName"], F.lit("?")), m["Value"])))).alias("metrics"),
        F.try_variant_get("v", "$.HyperParameters", "map<string,string>").alias("params"))


def api_listing(docs: DataFrame, keys: Sequence[str], text: str = "text", shown: int = 40) -> DataFrame:
    """API items of each payload: total and the first ``shown`` items."""
    v = docs.select(*keys, parse_json(F.col(text)).alias("v")).where(F.col("v").isNotNull())
    items = v.select(*keys, F.coalesce(F.try_variant_get("v", "$", "array<variant>"),
                                       F.array("v")).alias("items"))
    rows = items.select(*keys, F.size("items").cast("bigint").alias("total"),
                        F.posexplode(F.slice("items", 1, shown)).alias("pos", "i"))
    published = F.coalesce(_get("i", "$.isCurrent", "boolean"), F.lit(False)) \
        | (_get("i", "$.state") == "published")
    return rows.select(
        *keys, "total", F.col("pos").cast("bigint").alias("pos"),
        F.coalesce(_get("i", "$.name"), _get("i", "$.displayName"), F.lit("?")).alias("name"),
        F.coalesce(_get("i", "$.path"), F.lit("")).alias("path"),
        F.when(published, "published").otherwise(F.coalesce(_get("i", "$.state"), F.lit("")))
        .alias("state"))


# --- cost tables -------------------------------------------------------------

def cost_rows(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Rows of ``columns[] / rows[][]`` cost payloads as (group, cost)."""
    v = docs.select(*keys, parse_json(F.col(text)).alias("v")).where(F.col("v").isNotNull())

    def part(name: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get("v", f"$.properties.{name}", kind),
                          F.try_variant_get("v", f"$.{name}", kind))

    t = v.select(*keys, F.transform(part("columns", "array<struct<name:string>>"),
                                    lambda c: F.lower(c["name"])).alias("cols"),
                 part("rows", "array<array<string>>").alias("rows"))

    def position(match) -> Column:
        flags = F.transform("cols", match)
        return F.nullif(F.array_position(flags, F.lit(True)), F.lit(0)) - 1

    cost_at = F.coalesce(position(lambda c: F.contains(c, F.lit("cost"))), F.lit(0))
    group_at = F.coalesce(position(lambda c: c.isin(*P.COST_GROUP_COLUMNS)),
                          F.when(F.size("cols") > 1, 1).otherwise(0))
    t = t.select(*keys, cost_at.cast("int").alias("c"), group_at.cast("int").alias("g"),
                 F.explode("rows").alias("r"))
    return t.select(*keys, F.coalesce(F.get("r", F.col("g")), F.lit("?")).alias("group"),
                    F.expr("try_cast(get(r, c) AS double)").alias("cost")) \
        .where(F.col("cost").isNotNull())


def allowed(name: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Any include pattern (if there are some) and no exclude pattern."""
    ok = F.lit(True)
    if include:
        ok = F.lit(False)
        for p in include:
            ok = ok | name.rlike(p)
    for p in exclude:
        ok = ok & ~name.rlike(p)
    return ok


def cost_topn(rows: DataFrame, group: str = "group", cost: str = "cost", k: int = 10,
              include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Top groups by cost next to the grand total and the number of groups."""
    kept = rows.where(allowed(F.col(group), include, exclude))
    sums = kept.groupBy(group).agg(F.sum(cost).alias("cost"))
    totals = sums.agg(F.struct(F.sum("cost").alias("total"), F.count("*").alias("groups"))).scalar()
    top = sums.orderBy(F.col("cost").desc(), group).limit(k)
    return top.withColumn("_t", totals).select(group, "cost", "_t.total", "_t.groups")


# --- cloud payloads as text --------------------------------------------------

def _lines(*parts: Column) -> Column:
    """The parts that are not null, one below the other."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def _pairs(entries: Column, shown: int) -> Column:
    return F.array_join(F.transform(F.slice(entries, 1, shown), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?")))), " ")


def _numbers(entries: Column) -> Column:
    """Numbers with four significant digits at most; other values as they are."""
    def short(x: Column) -> Column:
        exact = x.rlike(r"^-?[0-9]+$") | x.try_cast("double").isNull()
        return F.when(exact, x).otherwise(F.regexp_replace(F.regexp_replace(
            F.format_string("%.4g", x.try_cast("double")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), short(e["value"]).alias("value")))


def _object(v: Column, path: str) -> Column:
    return F.map_entries(F.coalesce(F.try_variant_get(v, path, "map<string,string>"), F.create_map().cast("map<string,string>")))


def _named(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths), F.lit("?"))


def _titled(title: str, body: Column) -> Column:
    return F.when(body != "", F.concat(F.lit(title), body))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(seconds.isNull(), "?").when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"))) \
        .when(m > 0, F.concat(m.cast("string"), F.lit("m"), F.lpad(s.cast("string"), 2, "0"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def cluster_text(v: Column) -> Column:
    pools = F.transform(F.coalesce(F.try_variant_get(v, "$.agentPoolProfiles", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.concat(
        _named(p, "$.name"), F.lit("("), _named(p, "$.count"), F.lit("x"), F.replace(_named(p, "$.vmSize"), F.lit("Standard_"), F.lit("")), F.lit(","),
        _named(p, "$.osType"), F.lit(","), _named(p, "$.mode"), F.lit(")")))
    managed = F.when(F.coalesce(F.try_variant_get(v, "$.aadProfile.managed", "boolean"), F.lit(False)), "AAD managed").otherwise("no AAD")
    tags = F.array_join(F.transform(F.slice(_object(v, "$.tags"), 1, 8), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), ", ")
    return _lines(
        F.concat(F.lit("AKS "), _named(v, "$.name"), F.lit(" | "), _named(v, "$.location"), F.lit(" | k8s "), _named(v, "$.kubernetesVersion"),
                 F.lit(" | "), _named(v, "$.provisioningState"), F.lit("/"), _named(v, "$.powerState.code")),
        _titled("Pools: ", F.array_join(pools, ", ")),
        F.concat(F.lit("Identity: "), _named(v, "$.identity.type"), F.lit(" | "), managed, F.lit(" | networkPlugin: "), _named(v, "$.networkProfile.networkPlugin")),
        _titled("tags: ", tags))


def job_text(v: Column) -> Column:
    """A training job of three services; null when no service's fields are there."""
    listed = F.transform(F.coalesce(F.try_variant_get(v, "$.FinalMetricDataList", "array<variant>"), F.array().cast("array<variant>")), lambda m: F.struct(
        _named(m, "$.MetricName").alias("key"), F.try_variant_get(m, "$.Value", "string").alias("value")))
    name = F.try_variant_get(v, "$.TrainingJobName", "string")
    first = _lines(
        F.concat(name, F.lit(" | "), _named(v, "$.TrainingJobStatus"), F.lit(" | "), duration(F.try_variant_get(v, "$.BillableTimeInSeconds", "bigint")),
                 F.lit(" billable | "), _named(v, "$.ResourceConfig.InstanceType")),
        _titled("HP: ", _pairs(_object(v, "$.HyperParameters"), 6)), _titled("Metrics: ", _pairs(_numbers(listed), 8)))
    second = _lines(
        F.concat(F.lit("AzureML job "), _named(v, "$.display_name", "$.name"), F.lit(" | "), _named(v, "$.status"), F.lit(" | compute: "),
                 _named(v, "$.compute", "$.resources.instance_type")),
        _titled("Metrics: ", _pairs(_numbers(_object(v, "$.metrics")), 8)))
    third = F.concat(F.lit("Vertex job "), _named(v, "$.displayName", "$.name"), F.lit(" | "), _named(v, "$.state"), F.lit(" | "),
                     _named(v, "$.jobSpec.workerPoolSpecs[0].machineSpec.machineType"))
    vertex = F.try_variant_get(v, "$.jobSpec", "variant").isNotNull() | F.try_variant_get(v, "$.state", "string").isNotNull()
    return F.when(name.isNotNull(), first).when(vertex, third).otherwise(second)


def cost_text(v: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Total and the ten most expensive groups; null without priced rows."""
    def part(name: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.properties.{name}", kind), F.try_variant_get(v, f"$.{name}", kind))

    def render(x: Column) -> Column:
        def position(match) -> Column:
            return F.nullif(F.array_position(F.transform(x["cols"], match), F.lit(True)), F.lit(0)).cast("int") - 1

        c = F.coalesce(position(lambda n: F.contains(n, F.lit("cost"))), F.lit(0))
        g = F.coalesce(position(lambda n: n.isin(*P.COST_GROUP_COLUMNS)), F.when(F.size(x["cols"]) > 1, 1).otherwise(0))
        rows = F.filter(F.transform(x["rows"], lambda r: F.struct(F.coalesce(F.get(r, g), F.lit("?")).alias("g"), F.get(r, c).try_cast("double").alias("c"))),
                        lambda r: r["c"].isNotNull() & allowed(r["g"], include, exclude))

        def summed(r: Column) -> Column:
            names = F.array_distinct(F.transform(r, lambda y: y["g"]))
            sums = F.array_sort(F.transform(names, lambda n: F.struct(
                (-F.aggregate(F.filter(r, lambda y: y["g"] == n), F.lit(0.0), lambda a, y: a + y["c"])).alias("c"), n.alias("g"))))
            total = F.aggregate(r, F.lit(0.0), lambda a, y: a + y["c"])
            return F.when(F.size(r) > 0, F.array_join(F.concat(
                F.array(F.format_string("Cost total: %.2f (%d groups)", total, F.size(names))),
                F.transform(F.slice(sums, 1, 10), lambda y: F.concat(F.lit("  "), y["g"], F.lit(": "), F.format_string("%.2f", -y["c"])))), "\n"))
        return let(rows, summed)

    cols = F.transform(part("columns", "array<variant>"), lambda c: F.lower(F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit(""))))
    return let(F.struct(cols.alias("cols"), part("rows", "array<array<string>>").alias("rows")),
               lambda x: F.when((F.size(x["cols"]) > 0) & (F.size(x["rows"]) > 0), render(x)))


def api_text(v: Column, shown: int = 40) -> Column:
    def one(i: Column) -> Column:
        live = F.coalesce(F.try_variant_get(i, "$.isCurrent", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get(i, "$.state", "string") == "published", F.lit(False))
        state = F.when(live, "published").otherwise(F.coalesce(F.try_variant_get(i, "$.state", "string"), F.lit("")))
        return F.rtrim(F.concat(F.lit("  "), _named(i, "$.name", "$.displayName"), F.lit(" "), F.coalesce(F.try_variant_get(i, "$.path", "string"), F.lit("")), F.lit(" "), state))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    more = F.size(items) - shown
    return _lines(F.concat(F.size(items).cast("string"), F.lit(" API item(s)")), F.nullif(F.array_join(F.transform(F.slice(items, 1, shown), one), "\n"), F.lit("")),
                  F.when(more > 0, F.concat(F.lit("  ...(+"), more.cast("string"), F.lit(" more)"))))


def compact_cloud(kind: Column, text: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Text of a known cloud payload (cluster, job, cost, api); null for any other kind or shape."""
    def render(v: Column) -> Column:
        def named(*paths: str) -> Column:
            return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths)).isNotNull()
        return (F.when((kind == "cluster") & named("$.name"), cluster_text(v))
                .when((kind == "job") & F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), job_text(v))
                .when(kind == "cost", cost_text(v, include, exclude)).when(kind == "api", api_text(v)))
    return let(parse_json(F.when(kind.isNotNull(), text)), lambda v: F.when(v.isNotNull(), render(v)))


# --- change sets -------------------------------------------------------------

PLAN_SCHEMA = ("struct<resource_changes: array<struct<address: string, change: struct<"
               "actions: array<string>, before: map<string,string>, after: map<string,string>>>>>")


def plan_changes(docs: DataFrame, keys: Sequence[str], text: str = "text",
                 include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """One row per planned resource change; no-op and read changes dropped."""
    plan = F.from_json(strip(F.col(text)), PLAN_SCHEMA)
    rc = docs.select(*keys, F.posexplode(plan["resource_changes"]).alias("pos", "rc")).select(
        *keys, "pos", F.coalesce(F.col("rc.address"), F.lit("?")).alias("address"),
        F.coalesce(F.col("rc.change.actions"), F.array().cast("array<string>")).alias("actions"),
        F.col("rc.change.before").alias("before"), F.col("rc.change.after").alias("after"))
    kept = rc.where((F.size("actions") > 0) & (F.array_join("actions", ",") != "no-op")
                    & (F.array_join("actions", ",") != "read")
                    & allowed(F.col("address"), include, exclude))
    joined = F.array_join("actions", ",")
    kind = (F.when(F.array_join(F.array_sort("actions"), ",") == "create,delete", "replace")
            .otherwise(joined))
    return kept.select(*keys, F.col("pos").cast("bigint").alias("pos"), "address",
                       kind.alias("action"), "actions", "before", "after")


def plan_summary(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of added, changed and destroyed resources; a replace is both."""
    return changes.groupBy(*by).agg(
        F.count_if(F.array_contains("actions", "create")).alias("adds"),
        F.count_if(F.array_join("actions", ",") == "update").alias("changes"),
        F.count_if(F.array_contains("actions", "delete")).alias("destroys"))


def short_value(v: Column) -> Column:
    """A scalar clipped to 40 characters; of a nested value only ``{...}`` or the number of items.

    Attribute values are JSON text (strings without quotes); a nested one may hold secrets at any depth.
    """
    items = F.size(F.from_json(v, "array<string>"))
    return (F.when(v.rlike(r"^\s*\{"), "{...}")
            .when(v.rlike(r"^\s*\["), F.concat(F.lit("["), F.coalesce(items, F.lit(1)).cast("string"), F.lit("]")))
            .when(F.length(v) <= 40, v).otherwise(F.concat(F.substring(v, 1, 37), F.lit("..."))))


def attr_diff(changes: DataFrame, keys: Sequence[str], limit: int = P.ATTRS_SHOWN,
              removed: bool = False) -> DataFrame:
    """Changed attributes: one row per shown attribute plus how many are hidden.

    Both maps sit in the row, so the comparison needs no join.  ``removed`` also
    reports attributes that are gone after the change.
    """
    before = F.coalesce("before", F.create_map().cast("map<string,string>"))
    after = F.coalesce("after", F.create_map().cast("map<string,string>"))
    diff = F.filter(
        F.transform(F.map_entries(after), lambda e: F.struct(
            e["key"].alias("attr"), F.try_element_at(before, e["key"]).alias("old"),
            e["value"].alias("new"))),
        lambda d: ~d["old"].eqNullSafe(d["new"]))
    if removed:
        gone = F.filter(F.map_entries(before), lambda e: ~F.map_contains_key(after, e["key"]))
        diff = F.concat(diff, F.transform(gone, lambda e: F.struct(
            e["key"].alias("attr"), e["value"].alias("old"), F.lit(None).cast("string").alias("new"))))
    rows = changes.withColumn("_diff", diff).select(
        *keys, F.greatest(F.size("_diff") - limit, F.lit(0)).cast("bigint").alias("hidden"),
        F.posexplode(F.slice("_diff", 1, limit)).alias("pos", "d"))
    secret = is_secret_key(F.col("d.attr"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("d.attr").alias("attr"),
                       F.when(secret, P.MASK).otherwise(short_value(F.col("d.old"))).alias("old"),
                       F.when(secret, P.MASK).otherwise(short_value(F.col("d.new"))).alias("new"),
                       "hidden")
