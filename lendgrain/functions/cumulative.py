"""Running sums that survive an account holding a large share of all rows.

A plain window puts every row of a key into one task. Here a key is cut into chunks:
chunk totals are aggregated first (with map-side combine), one small window turns them
into the sum carried into each chunk, and the carried sum joins the rows as one extra
leading row per chunk. The wide window is then per key *and* chunk.

Chunks are stretches of time as long as none of them is large. Where many rows share an
hour, or one instant, chunks are instead the partitions of a range partitioning by key,
time and tie: Spark samples its bounds, so rows of one instant spread over the tasks by
their ties.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.session import settle

HOUR_MICROS = 3_600_000_000
CHUNK_ROWS = 500_000


def running_sum(
    rows: DataFrame, keys: list[str], at: str, tie: list[str], value: str, out: str,
    chunk_micros: int = HOUR_MICROS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``out``, the sum of ``value`` up to and including each row.

    Rows are ordered within ``keys`` by ``at`` (microseconds) and ``tie``, which should tell
    rows of one instant apart. More than ``chunk_rows`` rows in a chunk of time change how
    rows are dealt out, not the result.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col(at) / F.lit(chunk_micros)))
    summed = lambda chunks: chunks.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    totals = settle(summed(chunked))
    size = totals.agg(F.max("_rows").alias("most"), F.sum("_rows").alias("all")).first()
    if (size.most or 0) > chunk_rows:
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(2 * size.all / chunk_rows))
        chunked = settle(rows.repartitionByRange(tasks, *keys, at, *tie).withColumn("_chunk", F.spark_partition_id().cast("long")))
        totals = summed(chunked)
    ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_chunk", F.sum("_total").over(ahead).alias(value), F.lit(0).alias("_row"))
    both = chunked.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy("_row", at, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return both.withColumn(out, F.sum(value).over(inside)).filter("_row = 1").drop("_chunk", "_row")
