"""Session helpers: building a session, reading a table, cutting lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sigweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and a pinned time zone.

    Results do not depend on these settings; in a session made elsewhere some joins take one more exchange.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # a side already partitioned on `entity` may join on (entity, outcome) as it is
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # stored intermediate tables go when no frame refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did (a path that all machines must have)."""
    here, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage.

    Used where a later step must see the very same physical rows twice (for
    example rows and the per-partition totals of those rows): recomputing after
    an executor loss may otherwise place the range boundaries differently.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, visible to every executor."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets go of the tables of finished rounds at once.

    Spark's cleaner removes shuffles, broadcasts and checkpoint files when the driver's collector finds that no frame refers
    to them, which may be long after many rounds of small jobs. Here Python's references go first, then the driver collects.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
