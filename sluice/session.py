"""Session helpers: a tuned local session for tests/bench and the shared
checkpoint folder used to cut lineage in multi-pass operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Where a local session without spark.checkpoint.dir keeps its intermediate tables.
_LOCAL_DIR = "spark.sluice.localCheckpointDir"


def build_session(master: str | None = None, app: str = "sluice", **conf) -> SparkSession:
    """A session with the settings this library expects (tests and bench).

    On a cluster, pass the cluster's master and leave checkpoint settings to
    the cluster configuration.
    """
    cpus = os.environ.get("BENCH_CPUS") or "8"
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only a local session (tests) may leave it unset and gets a private temp
    folder; on a cluster that would scatter files over the machines' own
    disks, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_DIR, None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    configured = tempfile.mkdtemp(prefix="sluice-ckpt-")
    spark.conf.set(_LOCAL_DIR, configured)
    return configured


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder, with
    ``options`` of the writer, and read it back, cutting the lineage.

    Used where one intermediate feeds two consumers that must see identical
    rows (ids assigned after a range sort), or where a side effect (an API
    call) must not run twice.  The data is computed exactly once (unlike an
    RDD checkpoint, which recomputes an unpersisted input to save it), and
    survives executor loss, unlike a cache or a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.mode("error").options(**options).parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path under the shared checkpoint folder, freed with the surrounding scope if there is one."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/sluice-{uuid.uuid4().hex}"
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)
    return path


_SCOPE: ContextVar[list[str] | None] = ContextVar("sluice_scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Frees the intermediate tables written inside the block when it ends.

    A table is freed by overwriting it with no rows, which works on any store
    that Spark writes to.  Frames read from it must not be used afterwards.
    """
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            spark.range(0).write.mode("overwrite").parquet(path)


def cluster_settings(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Spark settings for a cluster run over ``input_bytes`` of input.

    Shuffle partitions are sized so one partition holds about
    ``target_partition_bytes``; AQE then coalesces small ones and splits
    skewed ones at run time.  File splits match the same size.  The shared
    checkpoint folder (``spark.checkpoint.dir``) is the cluster's to set.
    """
    partitions = max(200, min(200_000, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.session.timeZone": "UTC",
    }
