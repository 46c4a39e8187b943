"""Round trips and running totals of accounts whose transactions arrive as a stream.

Streams carry the columns of ``operators.bank``'s transactions. Round trips are an interval join
of debits and credits: the watermark and the interval bound how long a row waits for its partners,
so state holds ``days`` of rows plus the allowed delay. Totals keep one state row per key, and each
micro-batch writes the keys it changed to a folder of its own; a batch that runs again after a
failure overwrites its folder, so every row counts once.

Late rows: a row older than the watermark finds no round trips any more and is counted by Spark
(``late_rows``); totals have no watermark and take rows of any age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lendgrain import fixed_values as fv

DAY = 86_400_000_000


def round_trips(
    txns: DataFrame, delay: str = "2 days", days: int = fv.ROUND_TRIP_DAYS, min_amount: float = fv.ROUND_TRIP_MIN,
) -> DataFrame:
    """Stream of pairs of a large debit and a large credit of one party within ``days``, each once.

    ``delay``: how much older than the newest row a row may arrive. The day gap is floored before its
    sign is dropped, as in ``bank.round_trips``.
    """
    usable = txns.filter("party IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)

    def side(kind: str) -> DataFrame:
        return usable.filter(F.col(kind) > min_amount).select(
            F.col("applicant_id").alias(f"{kind}_applicant"), F.col("party").alias(f"{kind}_party"), F.col("seq").alias(f"{kind}_seq"),
            F.col("ts").alias(f"{kind}_ts"), F.col(kind).alias(f"{kind}_amount"))

    near = F.expr(
        "debit_applicant = credit_applicant AND debit_party = credit_party "
        f"AND credit_ts > debit_ts - INTERVAL {days + 1} DAYS AND credit_ts <= debit_ts + INTERVAL {days} DAYS")
    gap = F.abs(F.floor((F.unix_micros("debit_ts") - F.unix_micros("credit_ts")) / F.lit(DAY)))
    return side("debit").join(side("credit"), near).select(
        F.col("debit_applicant").alias("applicant_id"), F.col("debit_party").alias("party"), "debit_seq", "debit_ts", "debit_amount",
        "credit_seq", "credit_ts", "credit_amount", gap.alias("days_gap"))


def write_round_trips(trips: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append pairs as Parquet; Spark's file sink commits each micro-batch once, also after a restart."""
    return _started(trips.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, **options)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream dropped because they were older than its watermark."""
    return sum(int(state["numRowsDroppedByWatermark"]) for progress in query.recentProgress for state in progress["stateOperators"])


def counterparty_totals(txns: DataFrame) -> DataFrame:
    """Stream of each counterparty's debit, credit, count and first position so far."""
    return txns.filter("party IS NOT NULL").groupBy("applicant_id", "party").agg(
        F.sum("debit").alias("debit_volume"), F.sum("credit").alias("credit_volume"),
        F.count(F.lit(1)).alias("txn_count"), F.min("seq").alias("first_seq"))


def statement_totals(txns: DataFrame) -> DataFrame:
    """Stream of each account's totals so far; the balance sum and count give the mean of its non-zero balances."""
    balance = F.nullif("balance", F.lit(0.0))
    return txns.groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("total_transactions"), F.sum("debit").alias("total_debits"), F.sum("credit").alias("total_credits"),
        F.sum(balance).alias("balance_sum"), F.count(balance).alias("balances"))


def write_totals(totals: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Write the totals that each micro-batch changed to ``path/batch=<number>``."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return _started(totals.writeStream.foreachBatch(put).outputMode("update"), checkpoint, **options)


def latest_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest totals of every key."""
    changed = spark.read.parquet(path)
    values = [c for c in changed.columns if c not in (*keys, "batch")]
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def with_average(totals: DataFrame) -> DataFrame:
    """Account totals with the mean balance in place of its sum and count, as ``bank.statement_summary`` returns them."""
    mean = F.coalesce(F.try_divide("balance_sum", "balances"), F.lit(0.0))
    return totals.withColumn("avg_balance", F.round(mean, 2)).drop("balance_sum", "balances")


def _started(writer, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
