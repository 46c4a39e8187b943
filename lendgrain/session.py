"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD_BYTES = 256 << 20


def build_session(app: str = "lendgrain", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the adaptive settings the operators are designed for.

    Skewed joins are split even when that costs one more exchange: an applicant,
    a party or a source may hold a large share of all rows.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def settle(frame: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage, for results that several others read.

    Written to the reliable checkpoint folder all executors share, so a lost executor
    costs no recomputation of what came before.
    """
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)


def sent_if_few(frame: DataFrame, rows: int = 10_000) -> DataFrame:
    """A table marked for broadcast if a count, which stops beyond ``rows``, shows it to be small; else as it is."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def spread(frame: DataFrame, *key: str) -> DataFrame:
    """Give every core a share of a small table with costly rows.

    A single file may hold all rows in one row group, which Spark cannot split. Tables of
    more than ``SPREAD_BYTES`` have many, and are returned as they are, however many cores
    there are. The columns of ``key`` should be unique together.
    """
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return frame
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism, *key)
