"""Labels for fitting: which rows may be learnt from, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.frames import BROADCAST_ROWS

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the doc_id's text divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label) of the rows to learn from; a doc_id labelled twice counts once, with its larger label."""
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on doc_id; labels are sent to the rows if a count shows them to be few."""
    few = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(labels) if few else labels, "doc_id")
