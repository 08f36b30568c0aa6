"""Session settings shared by the entry module, the bench and the tests."""
from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tapelens", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str | None:
    """Shared folder for lineage cuts: the cluster's own, or a scratch one in local mode only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not folder and (context.master == "local" or context.master.startswith("local[")):
        folder = tempfile.mkdtemp(prefix="spark-tapelens-")
    if folder:
        context.setCheckpointDir(folder)
    return folder or None


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that several branches read.

    The reliable checkpoint survives lost executors: readers re-read files instead
    of replaying prints. A cluster has to name a shared folder.
    """
    if checkpoint_folder(df.sparkSession) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return df.checkpoint(eager=True)


_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application and read by every report on it.

    It is a snapshot of the source tables at first use; ``clear_stages`` drops it.
    """
    key = (spark.sparkContext.applicationId, root, name)
    if key not in _STAGES:
        _STAGES[key] = materialise(build())
    return _STAGES[key]


def clear_stages() -> None:
    _STAGES.clear()
