"""Helpers for frames that operators share: prepared documents, size-checked broadcasts, components."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.session import settle

#: Rows of long keys that may be broadcast: 16 MB at most.
BROADCAST_ROWS = 1_000_000
BATCH_ROWS = 500


def small_batches(frame: DataFrame) -> DataFrame:
    """Hand Python workers at most ``BATCH_ROWS`` rows at once, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = frame.sparkSession.conf
    if int(conf.get(key)) > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return frame


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on whole texts read; other columns may have any name."""
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def rows_of_ids(rows: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key is (left_anti: is not) among ``ids``. Few ids go to the rows, many meet them in a shuffle."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def release(frame: DataFrame) -> DataFrame:
    """Let go of finished shuffles. Their files stay until the driver has collected their handles, which
    may be hours on a driver with little garbage; call it after ``settle`` of a large shuffle's outcome.

    Python drops its proxies first, the JVM what they stood for; the second round gets what the first freed.
    """
    for _ in range(4):
        gc.collect()
        frame.sparkSession._jvm.System.gc()
        time.sleep(0.3)
    return frame


def settled(frame: DataFrame) -> DataFrame:
    """``settle``, and release of the shuffles before it: for outcomes of large shuffles.

    Hand in the frame as an expression: whoever still names it keeps its shuffles.
    """
    outcome = settle(frame)
    del frame
    return release(outcome)


def components(links: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id reachable, for every id in ``links`` (a, b).

    Alternates two steps until nothing changes: every node hands its larger neighbours, then
    its smaller ones, to its smallest neighbour. Links only move towards smaller ids, their
    number never grows, and a chain of n nodes takes about log n rounds. The minimum per node
    is combined before the shuffle, and links of a hub are split by adaptive skew joins.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = settle(small.filter("u <> v").distinct())
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == tuple(row):
            break
        state = tuple(row)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
