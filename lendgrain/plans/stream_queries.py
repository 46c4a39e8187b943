"""Statement signals over the event table as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lendgrain.functions.party import with_party
from lendgrain.operators import bank
from lendgrain.plans.bindings import TXNS
from lendgrain.plans.registry import query
from lendgrain.plans.statement_queries import PAIRS, WITH_TXNS
from lendgrain.session import shared_folder
from lendgrain.streaming import statements

BATCHES = 4


def arriving(spark, sf_dir):
    """Transactions as a stream of ``BATCHES`` micro-batches that mix all dates, and a folder for its outcome."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = with_party(TXNS.frame(spark, sf_dir))
    for part in range(BATCHES):
        rows.filter(F.pmod(F.xxhash64("seq"), F.lit(BATCHES)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return stream, folder


@query("streamed_round_trips", f"""{WITH_TXNS}, {PAIRS}
SELECT applicant_id, party, debit_seq, credit_seq, debit_amount, credit_amount, days_gap FROM pairs""")
def streamed_round_trips(spark, sf_dir):
    stream, folder = arriving(spark, sf_dir)
    statements.write_round_trips(statements.round_trips(stream, delay="60 days"), f"{folder}/trips", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/trips").select(
        "applicant_id", "party", "debit_seq", "credit_seq", "debit_amount", "credit_amount", "days_gap")


@query("streamed_statement_summary", f"""{WITH_TXNS}
SELECT applicant_id, count(*) AS total_transactions, sum(debit) AS total_debits, sum(credit) AS total_credits,
       round(coalesce(avg(CASE WHEN balance <> 0 THEN balance END), 0.0), 2) AS avg_balance
FROM txnp GROUP BY applicant_id""")
def streamed_statement_summary(spark, sf_dir):
    stream, folder = arriving(spark, sf_dir)
    statements.write_totals(statements.statement_totals(stream), f"{folder}/totals", f"{folder}/state").awaitTermination()
    return statements.with_average(statements.latest_totals(spark, f"{folder}/totals", ["applicant_id"]))


@query("streamed_top_counterparties", f"""{WITH_TXNS},
v AS (SELECT applicant_id, party, sum(debit) AS d, sum(credit) AS c, count(*) AS n, min(seq) AS s
  FROM txnp WHERE party IS NOT NULL GROUP BY applicant_id, party),
r AS (SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY d + c DESC, s) AS rk FROM v)
SELECT applicant_id, CAST(rk AS INTEGER) AS rank, party, round(d + c, 2) AS total_volume, round(d, 2) AS debit_volume,
       round(c, 2) AS credit_volume, n AS txn_count FROM r WHERE rk <= 10""")
def streamed_top_counterparties(spark, sf_dir):
    stream, folder = arriving(spark, sf_dir)
    statements.write_totals(statements.counterparty_totals(stream), f"{folder}/totals", f"{folder}/state").awaitTermination()
    totals = statements.latest_totals(spark, f"{folder}/totals", ["applicant_id", "party"])
    return bank.top_counterparties(totals.withColumn("total_volume", F.col("debit_volume") + F.col("credit_volume")))
