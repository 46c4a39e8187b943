"""Bank statement and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions.party import with_party
from lendgrain.operators import bank, decision
from lendgrain.plans.bindings import PARTY_SQL, TXNS
from lendgrain.plans.registry import query

DAY = 86_400_000_000
WITH_TXNS = f"WITH {TXNS.cte}, {PARTY_SQL}"
PAIRS = f"""pairs AS (
  SELECT d.applicant_id, d.party, d.seq AS debit_seq, d.date_str AS debit_date, d.debit AS debit_amount,
         c.seq AS credit_seq, c.date_str AS credit_date, c.credit AS credit_amount,
         CAST(abs(floor((epoch_us(d.ts) - epoch_us(c.ts)) / 86400000000.0)) AS BIGINT) AS days_gap
  FROM txnp d JOIN txnp c ON d.applicant_id = c.applicant_id AND d.party = c.party
  WHERE d.debit > 10000 AND c.credit > 10000
    AND abs(floor((epoch_us(d.ts) - epoch_us(c.ts)) / 86400000000.0)) <= 7)"""
MEDIANS = """ranked AS (
  SELECT applicant_id, credit, row_number() OVER (PARTITION BY applicant_id ORDER BY credit) AS rn,
         count(*) OVER (PARTITION BY applicant_id) AS n FROM txnp WHERE credit > 0),
medians AS (SELECT applicant_id, credit AS median_credit, greatest(credit * 3, 100000.0) AS threshold
  FROM ranked WHERE rn = n // 2 + 1)"""
SPIKES = """dues AS (SELECT *, CASE WHEN 1 - day(ts) BETWEEN 0 AND 3 THEN 1 WHEN 11 - day(ts) BETWEEN 0 AND 3 THEN 11
    WHEN 20 - day(ts) BETWEEN 0 AND 3 THEN 20 END AS due FROM txnp),
spikes AS (SELECT t.applicant_id, t.seq, t.date_str, t.credit AS amount,
  lpad(CAST(t.due AS VARCHAR), 2, '0') || strftime(t.ts, '-%m-%Y') AS nearest_filing_date,
  CAST(t.due - day(t.ts) AS INTEGER) AS days_before_filing
  FROM dues t JOIN medians m USING (applicant_id)
  WHERE t.due IS NOT NULL AND t.credit >= m.threshold AND t.description LIKE '%CASH%')"""
RULE_VALUES = ", ".join(
    "('{}', {}, {}, {})".format(r[0], r[2], r[3], "true" if r[4] else "false") for r in fv.RULES)
RULES = f"rules(rule_id, bps, cut, manual) AS (VALUES {RULE_VALUES})"


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_party(TXNS.frame(spark, sf_dir))


@query("statement_summary", f"""{WITH_TXNS}
SELECT applicant_id, count(*) AS total_transactions, sum(debit) AS total_debits, sum(credit) AS total_credits,
       round(coalesce(avg(CASE WHEN balance <> 0 THEN balance END), 0.0), 2) AS avg_balance
FROM txnp GROUP BY applicant_id""")
def statement_summary(spark, sf_dir):
    return bank.statement_summary(TXNS.frame(spark, sf_dir))


@query("counterparty_volumes", f"""{WITH_TXNS}
SELECT applicant_id, party, sum(debit) AS debit_volume, sum(credit) AS credit_volume, count(*) AS txn_count,
       min(seq) AS first_seq, sum(debit) + sum(credit) AS total_volume
FROM txnp WHERE party IS NOT NULL GROUP BY applicant_id, party""")
def counterparty_volumes(spark, sf_dir):
    return bank.counterparty_volumes(txns(spark, sf_dir))


@query("top_counterparties", f"""{WITH_TXNS},
v AS (SELECT applicant_id, party, sum(debit) AS d, sum(credit) AS c, count(*) AS n, min(seq) AS s
  FROM txnp WHERE party IS NOT NULL GROUP BY applicant_id, party),
r AS (SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY d + c DESC, s) AS rk FROM v)
SELECT applicant_id, CAST(rk AS INTEGER) AS rank, party, round(d + c, 2) AS total_volume, round(d, 2) AS debit_volume,
       round(c, 2) AS credit_volume, n AS txn_count FROM r WHERE rk <= 10""")
def top_counterparties(spark, sf_dir):
    return bank.top_counterparties(bank.counterparty_volumes(txns(spark, sf_dir)))


@query("spike_threshold", f"{WITH_TXNS}, {MEDIANS} SELECT * FROM medians")
def spike_threshold(spark, sf_dir):
    return bank.spike_threshold(TXNS.frame(spark, sf_dir))


@query("cash_spikes", f"{WITH_TXNS}, {MEDIANS}, {SPIKES} SELECT * FROM spikes")
def cash_spikes(spark, sf_dir):
    return bank.cash_spikes(TXNS.frame(spark, sf_dir))


@query("capped_cash_spikes", f"""{WITH_TXNS}, {MEDIANS}, {SPIKES},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY applicant_id ORDER BY seq) AS INTEGER) AS rank FROM spikes)
SELECT * FROM r WHERE rank <= 3""")
def capped_cash_spikes(spark, sf_dir):
    return bank.cap_findings(bank.cash_spikes(TXNS.frame(spark, sf_dir)), ["seq"], 3)


@query("round_trip_counts", f"""{WITH_TXNS}, {PAIRS}
SELECT applicant_id, party, count(*) AS round_trips, count(DISTINCT debit_seq) AS matched_debits
FROM pairs GROUP BY applicant_id, party""")
def round_trip_counts(spark, sf_dir):
    return bank.round_trip_counts(txns(spark, sf_dir))


@query("round_trips", f"""{WITH_TXNS}, {PAIRS},
firsts AS (SELECT applicant_id, party, min(seq) AS party_seq FROM txnp
  WHERE debit > 0 AND party IS NOT NULL GROUP BY applicant_id, party),
r AS (SELECT p.*, row_number() OVER (PARTITION BY p.applicant_id ORDER BY party_seq, debit_seq, credit_seq) AS rk
  FROM pairs p JOIN firsts USING (applicant_id, party))
SELECT applicant_id, CAST(rk AS INTEGER) AS rank, party, debit_date, debit_amount, credit_date, credit_amount, days_gap
FROM r WHERE rk <= 10""")
def round_trips(spark, sf_dir):
    return bank.round_trips(txns(spark, sf_dir))


@query("running_balance", f"""{WITH_TXNS}
SELECT applicant_id, seq, round(50000.0 + sum(credit - debit)
  OVER (PARTITION BY applicant_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 2) AS balance FROM txnp""")
def running_balance(spark, sf_dir):
    return bank.running_balance(TXNS.frame(spark, sf_dir)).select("applicant_id", "seq", "balance")


@query("merged_statement_balance", f"""{WITH_TXNS},
u AS (SELECT applicant_id, ts, seq, 1 AS part, credit - debit AS m FROM txnp
  UNION ALL SELECT applicant_id, ts, seq, 0 AS part, debit - credit AS m FROM txnp WHERE debit > 200000)
SELECT applicant_id, seq, part, round(50000.0 + sum(m)
  OVER (PARTITION BY applicant_id ORDER BY ts, part * 1000000000000 + seq ROWS UNBOUNDED PRECEDING), 2) AS balance
FROM u""")
def merged_statement_balance(spark, sf_dir):
    base = TXNS.frame(spark, sf_dir)
    reversal = base.filter("debit > 200000").withColumns({"debit": F.col("credit"), "credit": F.col("debit")})
    merged = bank.merge_txns(reversal, base).withColumn("row", F.col("seq"))
    ordered = merged.withColumn("seq", F.col("part") * F.lit(1_000_000_000_000) + F.col("seq"))
    return bank.running_balance(ordered).select("applicant_id", F.col("row").alias("seq"), "part", "balance")


FINDINGS = f"""{WITH_TXNS}, {PAIRS}, {MEDIANS}, {SPIKES},
found AS (SELECT applicant_id, 'P-28' AS rule_id, count(*) AS found FROM pairs GROUP BY applicant_id
  UNION ALL SELECT applicant_id, 'P-29', count(*) FROM spikes GROUP BY applicant_id)"""


@query("statement_findings", f"""{FINDINGS}
SELECT applicant_id, rule_id, found, CASE rule_id
  WHEN 'P-28' THEN 'CIRCULAR TRANSACTION: ' || found || ' round-trip flows detected within 7-day windows'
  ELSE 'CASH SPIKE: ' || found || ' large cash deposits within 3 days of GST filing dates' END AS finding
FROM found""")
def statement_findings(spark, sf_dir):
    return bank.statement_findings(txns(spark, sf_dir))


def statement_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bank.statement_findings(txns(spark, sf_dir))
    return decision.union_triggers(found.select(
        "applicant_id", "rule_id", F.lit("bank").alias("source"),
        F.when(F.col("rule_id") == "P-28", 0).otherwise(1).alias("source_ord")))


@query("statement_decisions", f"""{FINDINGS}, {RULES},
folded AS (SELECT f.applicant_id, sum(bps) AS bps, product(1 - cut / 100.0) AS kept, bool_or(manual) AS manual,
  count(*) AS n, list(f.rule_id ORDER BY f.rule_id) AS ids FROM found f JOIN rules USING (rule_id) GROUP BY 1)
SELECT a.applicant_id, round(9.0 + coalesce(bps, 0) / 100.0, 2) AS final_rate_pct,
  round(10.0 * coalesce(kept, 1.0), 2) AS final_limit_cr,
  CASE WHEN manual THEN 'MANUAL_REVIEW' WHEN n > 0 THEN 'CONDITIONAL_APPROVAL' ELSE 'APPROVE' END AS recommendation,
  coalesce(manual, false) AS requires_manual_review, coalesce(n, 0) AS rules_triggered,
  coalesce(n, 0) AS penalties_applied, CAST(coalesce(bps, 0) AS BIGINT) AS total_bps,
  coalesce(array_to_string(ids, ','), '') AS triggered_rules
FROM (SELECT DISTINCT applicant_id FROM txns) a LEFT JOIN folded USING (applicant_id)""")
def statement_decisions(spark, sf_dir):
    accounts = TXNS.frame(spark, sf_dir)
    priced = decision.decide(statement_triggers(spark, sf_dir), decision.rule_table(spark), accounts)
    return priced.withColumn("triggered_rules", F.array_join("triggered_rules", ","))
