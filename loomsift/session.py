"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "loomsift", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Large column expressions are built call by call; skip call-site capture.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only where none is set (tests, a laptop) does a local session get a temporary
    folder, one for each application; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="loomsift-")
    return _LOCAL_ROOTS[app]


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, deal: int = 1) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than cores.

    A larger table is left as it is, or dealt over ``deal`` tasks for each split: a split of
    narrow rows from which long texts are built may be millions of texts, long for one task.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    return df.repartition(deal * splits) if deal > 1 else df
