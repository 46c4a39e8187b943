"""Source, memo, model and whole-portfolio queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lendgrain.functions.party import with_party
from lendgrain.operators import bank, base_terms, decision, filings, financials, memo, network, prose
from lendgrain.plans import decision_queries as dq
from lendgrain.plans import network_queries as nq
from lendgrain.plans import portfolio
from lendgrain.plans import prose_queries as pq
from lendgrain.plans import verify_queries as vq
from lendgrain.plans.bindings import FILINGS, NOTES, TXNS, View, auditors, figures
from lendgrain.plans.registry import query
from lendgrain.session import settle, shared_folder
from lendgrain.sources import feeds, statements

# --- Statements in every header style ------------------------------------------------
two = lambda e: f"lpad(CAST({e} AS STRING), 2, '0')"
MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(ts) * 3 - 2 AS INTEGER), 3)"
YEAR = "CAST(year(ts) AS STRING)"
CLOCK = f"{two('hour(ts)')} || ':' || {two('minute(ts)')}"
LINES = View("raw_lines", "events", (
    "user_id % 25 AS applicant_id", "event_id AS seq", "ts", "value",
    f"CASE event_id % 10 WHEN 0 THEN {two('day(ts)')} || '-' || {two('month(ts)')} || '-' || {YEAR} "
    f"WHEN 1 THEN {two('day(ts)')} || '/' || {two('month(ts)')} || '/' || {YEAR} "
    f"WHEN 2 THEN {YEAR} || '-' || {two('month(ts)')} || '-' || {two('day(ts)')} "
    f"WHEN 3 THEN {YEAR} || '-' || {two('month(ts)')} || '-' || {two('day(ts)')} || 'T' || {CLOCK} || ':30Z' "
    f"WHEN 4 THEN {two('day(ts)')} || '-' || {MONTH} || '-' || {YEAR} "
    f"WHEN 5 THEN CAST(day(ts) AS STRING) || ' ' || {MONTH} || ' ' || {YEAR} "
    f"WHEN 6 THEN {two('day(ts)')} || '-' || {two('month(ts)')} || '-' || {YEAR} || ' ' || {CLOCK} "
    f"WHEN 7 THEN {two('day(ts)')} || '/' || {two('month(ts)')} || '/' || {YEAR} || ' ' || {CLOCK} || ':07.123' "
    "WHEN 8 THEN '' ELSE 'not a date' END AS d",
    "CASE event_id % 3 WHEN 0 THEN ' credit' WHEN 1 THEN 'DEBIT ' ELSE '' END AS kind",
    "'Rs ' || CAST(value AS STRING) || '/-' AS amount_text",
    "CASE WHEN event_type = 'error' THEN '' ELSE CAST(value AS STRING) END AS out_text",
    "CASE WHEN event_type = 'view' THEN '1,' || CAST(value AS STRING) ELSE '' END AS in_text",
    "CASE event_id % 4 WHEN 0 THEN '' ELSE 'bal 1.2.3' END AS bal_text", "event_type AS mode"))
HEADERS = ["applicant_id", "seq", " Txn Date", "TYPE", "Amount ", "Withdrawal", "deposit", "Closing Balance", "Mode"]


@query("parsed_statements", f"""WITH {LINES.cte}, t AS (SELECT *, CASE event_id_mod WHEN 3 THEN date_trunc('minute', ts) + INTERVAL 30 SECOND
    WHEN 6 THEN date_trunc('minute', ts) WHEN 7 THEN date_trunc('minute', ts) + INTERVAL 7 SECOND WHEN 8 THEN NULL WHEN 9 THEN NULL
    ELSE date_trunc('day', ts) END AS pts FROM (SELECT *, seq % 10 AS event_id_mod FROM raw_lines))
SELECT applicant_id, seq, strftime(pts, '%Y-%m-%d %H:%M:%S') AS ts, trim(d) AS date_str,
  CASE seq % 3 WHEN 0 THEN 0.0 WHEN 1 THEN value ELSE CASE WHEN out_text = '' THEN 0.0 ELSE value END END AS debit,
  CASE seq % 3 WHEN 0 THEN value WHEN 1 THEN 0.0 ELSE coalesce(TRY_CAST(replace(in_text, ',', '') AS DOUBLE), 0.0) END AS credit,
  0.0 + 0 AS balance, mode, '' AS description, CAST(NULL AS VARCHAR) AS txn_id, pts IS NULL AS date_missing FROM t
WHERE pts IS NOT NULL OR (seq % 3 < 2 AND value > 0)""".replace("0.0 + 0 AS balance", "CAST(0 AS DOUBLE) AS balance"))
def parsed_statements(spark, sf_dir):
    raw = LINES.frame(spark, sf_dir).select(
        "applicant_id", "seq", "d", "kind", "amount_text", "out_text", "in_text", "bal_text", "mode").toDF(*HEADERS)
    return statements.parse_statements(raw).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


NARRATED = View("narrated", "events", (
    "event_id", "CASE event_id % 12 WHEN 0 THEN 'upi/CR/' || CAST(event_id AS STRING) || '/Acme ' || CAST(user_id AS STRING) || '/ok' "
    "WHEN 1 THEN 'NEFT Dr-1-HDFC-Beta-Gamma ' || CAST(user_id AS STRING) || '-/NONE' WHEN 2 THEN 'RTGS/SBI/Delta ' || CAST(user_id AS STRING) "
    "WHEN 3 THEN 'IMPS BRN SALARY TRF BY-Epsilon ' || CAST(user_id AS STRING) WHEN 4 THEN 'IMPS Dr-77-Zeta ' || CAST(user_id AS STRING) "
    "WHEN 5 THEN 'By Clg: 12, Eta ' || CAST(user_id AS STRING) WHEN 6 THEN 'Chq Paid-MICR-Theta ' || CAST(user_id AS STRING) || '-HDFC' "
    "WHEN 7 THEN 'Dividend Cr-Iota ' || CAST(user_id AS STRING) || '-EQUITY' WHEN 8 THEN 'Cash Withdrawal-Kappa ' || CAST(user_id AS STRING) "
    "WHEN 9 THEN 'CASH DEP SELF-Lambda' WHEN 10 THEN 'ATM WDL-Mu-Nu-Xi' ELSE 'GST PAYMENT 27AA' END AS description",
    "CAST(user_id AS STRING) AS u"))


@query("counterparty_names", f"""WITH {NARRATED.cte} SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'ACME ' || u WHEN 1 THEN 'BETA-GAMMA ' || u
  WHEN 2 THEN 'DELTA ' || u WHEN 3 THEN 'EPSILON ' || u WHEN 4 THEN 'ZETA ' || u WHEN 5 THEN 'ETA ' || u WHEN 6 THEN 'THETA ' || u
  WHEN 7 THEN 'IOTA ' || u WHEN 8 THEN 'KAPPA ' || u END AS party FROM narrated""")
def counterparty_names(spark, sf_dir):
    return with_party(NARRATED.frame(spark, sf_dir)).select("event_id", "party")


PAYLOADS = View("payloads", "events", (
    "event_id", "user_id", "value",
    "'{\"applicant_id\": ' || CAST(event_id AS STRING) || ', \"opening_balance\": ' || CAST(user_id AS STRING) || '.5, \"transactions\": ["
    "{\"date\": \"2024-01-05\", \"description\": \"UPI/DR/1/P' || CAST(user_id AS STRING) || '/x\", \"debit\": ' || CAST(value AS STRING) || "
    "', \"credit\": null, \"balance\": 10.0, \"failed\": false}, {\"date\": \"2024-01-06T10:00:00\", \"description\": \"CASH\", "
    "\"debit\": null, \"credit\": 7.25, \"balance\": 17.25}]}' AS payload"))


@query("statement_json_rows", f"""WITH {PAYLOADS.cte} SELECT event_id AS applicant_id, user_id + 0.5 AS opening_balance, s AS seq,
  CASE s WHEN 0 THEN '2024-01-05 00:00' ELSE '2024-01-06 10:00' END AS ts, CASE s WHEN 0 THEN '2024-01-05' ELSE '2024-01-06T10:00:00' END AS date_str, CASE s WHEN 0 THEN 'UPI/DR/1/P' || user_id || '/x' ELSE 'CASH' END
  AS description, CASE s WHEN 0 THEN value ELSE 0.0 END AS debit, CASE s WHEN 0 THEN 0.0 ELSE 7.25 END AS credit,
  CAST(CASE s WHEN 0 THEN 10.0 ELSE 17.25 END AS DOUBLE) AS balance, false AS failed FROM payloads CROSS JOIN range(0, 2) r(s)""".replace(
    "user_id + 0.5 AS", "CAST(user_id AS DOUBLE) + 0.5 AS").replace("CASE s WHEN 0 THEN 0.0 ELSE 7.25 END AS credit",
                                                             "CAST(CASE s WHEN 0 THEN 0.0 ELSE 7.25 END AS DOUBLE) AS credit"))
def statement_json_rows(spark, sf_dir):
    parsed = PAYLOADS.frame(spark, sf_dir).select(
        F.from_json("payload", statements.STATEMENT_JSON).alias("s")).select("s.*")
    return statements.explode_statements(parsed).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm"))


@query("statement_lines", f"""WITH {TXNS.cte} SELECT applicant_id, seq, date_str AS "Date", description AS "Description",
  nullif(debit, 0) AS "Debit", nullif(credit, 0) AS "Credit", balance AS "Balance" FROM txns""")
def statement_lines(spark, sf_dir):
    return statements.statement_lines(TXNS.frame(spark, sf_dir))


# Statements of three banks, each with its own columns, in one folder.
BANKS = [
    {"Txn Date": "date_str", "Narration": "description", "Withdrawal": "debit", "Deposit": "credit", "Closing Balance": "balance"},
    {"BALANCE": "balance", " Date ": "date_str", "type": "kind", "Description": "description", "amount": "moved"},
    {"transactionDate": "date_str", "note": "CAST(seq AS STRING)", "credit": "credit", "Debit": "debit", "currentBalance": "balance",
     "particulars": "description", "reference": "CAST(seq AS STRING)"},
]


@query("statement_folder", f"""WITH {TXNS.cte} SELECT applicant_id, strftime(ts, '%Y-%m-%d') AS day, date_str, description, debit, credit, balance,
  CASE WHEN applicant_id % 3 = 2 THEN CAST(seq AS VARCHAR) END AS txn_id FROM txns""")
def statement_folder(spark, sf_dir):
    txns = settle(TXNS.frame(spark, sf_dir).selectExpr(
        "*", "CASE WHEN debit > 0 THEN 'debit' WHEN credit > 0 THEN 'Credit' ELSE '' END AS kind", "debit + credit AS moved"))
    folder = f"{shared_folder(spark)}/statements-{uuid.uuid4().hex}"
    for bank_no, columns in enumerate(BANKS):
        txns.filter(F.col("applicant_id") % 3 == bank_no).selectExpr(
            "applicant_id", *[f"CAST({value} AS STRING) AS `{name}`" for name, value in columns.items()]).write.mode("append").option(
            "header", True).partitionBy("applicant_id").csv(folder)
    return statements.read_statement_folder(spark, folder).select(
        "applicant_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "date_str", "description", "debit", "credit", "balance", "txn_id")


# --- Bureau feeds --------------------------------------------------------------------
ID = "CAST(c_custkey AS STRING)"
FEEDS = View("feed_rows", "customer", (
    "c_custkey",
    f"'{{\"applicant_id\": ' || {ID} || ', \"status\": \"' || CASE WHEN c_custkey % 9 = 0 THEN 'error' ELSE 'success' END || '\", "
    f"\"gstr_2a_3b_mismatch_pct\": ' || CAST(c_custkey % 30 AS STRING) || '.5, \"gst_turnover_cr\": 0.58, "
    "\"gst_filing_consistency\": \"Irregular\", \"gstr_3b_filings\": [{\"month\": \"Apr-23\", \"status\": \"Filed\", \"tax_paid_lakh\": 8.5}, "
    "{\"month\": \"May-23\", \"status\": \"' || CASE WHEN c_custkey % 2 = 0 THEN 'Delayed' ELSE 'Filed' END || '\"}]}' AS gst",
    f"'{{\"applicant_id\": ' || {ID} || ', \"status\": \"success\", \"director_disqualified\": ' || CASE WHEN c_custkey % 5 = 0 THEN 'true' "
    "ELSE 'false' END || ', \"active_litigations\": [\"Section 138\"], \"directors\": [{\"name\": \"A\", \"din\": \"01\"}, {\"name\": \"B\"}]}' AS registry",
    f"'{{\"applicant_id\": ' || {ID} || ', \"status\": \"success\", \"credit_score\": ' || CAST(c_custkey % 100 AS STRING) || "
    "', \"rating\": \"BB+\", \"dpd_30_count\": 2, \"suit_filed_amount_cr\": 3.5, \"facilities\": [{\"type\": \"Term Loan\", "
    "\"outstanding_cr\": 6.25}, {\"type\": \"Cash Credit\", \"outstanding_cr\": 2.5}]}' AS bureau",
    f"'{{\"applicant_id\": ' || {ID} || ', \"cases_found\": 1, \"cases\": [{{\"case_number\": \"C' || {ID} || '\", \"court\": \"NCLT\"}}]}}' AS courts",
    f"'{{\"applicant_id\": ' || {ID} || ', \"articles\": [{{\"headline\": \"Item ' || {ID} || '\", \"severity\": \"HIGH\"}}, "
    "{\"headline\": \"Other\", \"severity\": \"NONE\"}]}' AS news",
    f"'{{\"applicant_id\": ' || {ID} || ', \"nodes\": [{{\"id\": \"me\", \"type\": \"applicant\"}}], \"links\": [{{\"source\": \"me\", \"target\": \"v\", "
    f"\"value\": 5}}, {{\"source\": \"v\", \"target\": \"n\", \"value\": 4.75}}, {{\"source\": \"n\", \"target\": \"' || CASE WHEN c_custkey % 3 = 0 "
    "THEN 'me' ELSE 'z' END || '\", \"value\": 4.5}]}' AS graph"))


def feed(spark, sf_dir, kind):
    return feeds.parse_feed(FEEDS.frame(spark, sf_dir), kind, kind)


@query("gst_feed", """SELECT c_custkey AS applicant_id, c_custkey % 30 + CAST(0.5 AS DOUBLE) AS mismatch_pct, CAST(0.58 AS DOUBLE) AS turnover_cr,
  'Irregular' AS filing_consistency FROM customer WHERE c_custkey % 9 <> 0""")
def gst_feed(spark, sf_dir):
    return feeds.gst_evidence(feed(spark, sf_dir, "gst"))


@query("gst_filings", """SELECT c_custkey AS applicant_id, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN 'Apr-23' ELSE 'May-23' END AS month,
  CASE WHEN p = 1 AND c_custkey % 2 = 0 THEN 'Delayed' ELSE 'Filed' END AS status, CAST(CASE p WHEN 0 THEN 8.5 END AS DOUBLE) AS tax_paid_lakh,
  CAST(NULL AS DOUBLE) AS itc_claimed_lakh FROM customer CROSS JOIN range(0, 2) r(p)""")
def gst_filings(spark, sf_dir):
    return feeds.children(feed(spark, sf_dir, "gst"), "gstr_3b_filings")


@query("registry_feed", """SELECT c_custkey AS applicant_id, c_custkey % 5 = 0 AS director_disqualified, 'Unknown' AS epfo_compliance,
  'Section 138' AS active_litigations FROM customer""")
def registry_feed(spark, sf_dir):
    return feeds.registry_evidence(feed(spark, sf_dir, "registry")).withColumn(
        "active_litigations", F.array_join("active_litigations", "; "))


@query("bureau_feed", """SELECT c_custkey AS applicant_id, CAST(c_custkey % 100 AS INTEGER) AS credit_score, 'BB+' AS bureau_rating, 2 AS dpd_30,
  0 AS dpd_90, CAST(3.5 AS DOUBLE) AS suit_filed_cr FROM customer""")
def bureau_feed(spark, sf_dir):
    return feeds.bureau_evidence(feed(spark, sf_dir, "bureau"))


@query("bureau_facilities", """SELECT c_custkey AS applicant_id, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN 'Term Loan' ELSE 'Cash Credit' END AS type,
  CAST(CASE p WHEN 0 THEN 6.25 ELSE 2.5 END AS DOUBLE) AS outstanding_cr FROM customer CROSS JOIN range(0, 2) r(p)""")
def bureau_facilities(spark, sf_dir):
    return feeds.children(feed(spark, sf_dir, "bureau"), "facilities").select("applicant_id", "pos", "type", "outstanding_cr")


@query("court_cases", "SELECT c_custkey AS applicant_id, 'C' || c_custkey AS case_number, 'NCLT' AS court FROM customer")
def court_cases(spark, sf_dir):
    return feeds.children(feed(spark, sf_dir, "courts"), "cases").select("applicant_id", "case_number", "court")


@query("news_articles", """SELECT c_custkey AS applicant_id, CASE p WHEN 0 THEN 'Item ' || c_custkey ELSE 'Other' END AS headline,
  CASE p WHEN 0 THEN 'HIGH' ELSE 'NONE' END AS severity FROM customer CROSS JOIN range(0, 2) r(p)""")
def news_articles(spark, sf_dir):
    return feeds.children(feed(spark, sf_dir, "news"), "articles").select("applicant_id", "headline", "severity")


@query("graph_loops", """SELECT c_custkey AS applicant_id, 'me>v>n' AS path, CAST(4.5 AS DOUBLE) AS loop_value, 3 AS length, true AS through_applicant FROM customer
WHERE c_custkey % 3 = 0""")
def graph_loops(spark, sf_dir):
    graph = feed(spark, sf_dir, "graph")
    return network.circular_loops(feeds.graph_edges(graph), feeds.graph_anchors(graph)).withColumn(
        "path", F.array_join("path", ">"))


BROKEN = View("sent", "customer", (
    "c_custkey", "CASE c_custkey % 50 WHEN 0 THEN substr(gst, 1, 40) WHEN 1 THEN replace(gst, '0.58', '{}') WHEN 2 THEN "
    "replace(gst, 'applicant_id', 'applicant') ELSE gst END AS line"))


@query("feed_quarantine", f"""WITH feed_rows AS (SELECT c_custkey FROM customer)
SELECT CASE c_custkey % 50 WHEN 0 THEN 'damaged' WHEN 1 THEN 'damaged' WHEN 2 THEN 'no applicant' ELSE 'whole' END AS reason,
  CASE WHEN c_custkey % 50 > 2 THEN c_custkey END AS applicant_id, count(*) AS lines FROM feed_rows GROUP BY ALL""")
def feed_quarantine(spark, sf_dir):
    folder = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    FEEDS.frame(spark, sf_dir).selectExpr(BROKEN.columns[1]).write.text(folder)
    good, bad = feeds.read_feed_checked(spark, "gst", folder)
    counted = feeds.quarantine_counts(bad).groupBy("reason").agg(F.sum("lines").alias("lines"))
    return good.groupBy("applicant_id").agg(F.count(F.lit(1)).alias("lines")).select(F.lit("whole").alias("reason"), "applicant_id", "lines").unionByName(
        counted.select("reason", F.lit(None).cast("bigint").alias("applicant_id"), "lines"))


# --- Base terms ----------------------------------------------------------------------
@query("proxy_ratios", f"""{vq.BASE} SELECT applicant_id, CAST(CASE WHEN filing_consistency = 'Regular' THEN 95 ELSE 70 END AS DOUBLE)
  AS gst_compliance_pct, round(3.0 + mismatch_pct * 0.05, 2) AS leverage_ratio FROM gst""")
def proxy_ratios(spark, sf_dir):
    return base_terms.proxy_ratios(vq.tables(spark, sf_dir)["gst"])


RATIO_SQL = f"""{vq.BASE}, raw AS (SELECT a.applicant_id, CAST(CASE WHEN n % 7 <> 0 THEN (6 + c % 29) END AS DOUBLE) / 10 AS dscr,
  round(3.0 + mismatch_pct * 0.05, 2) AS leverage_ratio, CAST(c % 45 - 10 AS DOUBLE) AS revenue_growth_pct,
  CAST(n AS DOUBLE) AS years_in_business FROM facts a LEFT JOIN gst USING (applicant_id))"""


def raw_ratios(spark, sf_dir):
    t = vq.tables(spark, sf_dir)
    return t["facts"].join(base_terms.proxy_ratios(t["gst"]).drop("gst_compliance_pct"), "applicant_id", "left").select(
        "applicant_id", (F.when(F.col("n") % 7 != 0, 6 + F.col("c") % 29).cast("double") / 10).alias("dscr"),
        "leverage_ratio", (F.col("c") % 45 - 10).cast("double").alias("revenue_growth_pct"),
        F.col("n").cast("double").alias("years_in_business"))


@query("imputed_ratios", f"""{RATIO_SQL} SELECT applicant_id, coalesce(dscr, 1.3) AS dscr, coalesce(leverage_ratio, 3.2) AS leverage_ratio,
  CAST(1.35 AS DOUBLE) AS current_ratio, revenue_growth_pct, CAST(85 AS DOUBLE) AS gst_compliance_pct,
  CAST(52 AS DOUBLE) AS promoter_holding_pct, years_in_business FROM raw""")
def imputed_ratios(spark, sf_dir):
    return base_terms.impute(raw_ratios(spark, sf_dir))


@query("predicted_base_terms")
def predicted_base_terms(spark, sf_dir):
    ratios = base_terms.impute(raw_ratios(spark, sf_dir))
    train = ratios.withColumns({
        "base_rate": 8.5 + F.greatest(F.lit(0.0), 1.5 - F.col("dscr")) + 0.3 * F.greatest(F.lit(0.0), F.col("leverage_ratio") - 3.5),
        "base_limit": 10.0 + 2.0 * F.greatest(F.lit(0.0), F.col("dscr") - 1.0)})
    return base_terms.predict_base_terms(base_terms.fit_base_terms(train), ratios)


# Two steps in two ratios: every tree finds both, so each leaf's mean is known.
@query("reloaded_base_terms", f"""{RATIO_SQL} SELECT applicant_id, CAST(CASE WHEN coalesce(dscr, 1.3) < 1 THEN 12 ELSE 9 END AS DOUBLE) AS ml_base_rate_pct,
  CAST(CASE WHEN coalesce(leverage_ratio, 3.2) > 3.5 THEN 5 ELSE 10 END AS DOUBLE) AS ml_base_limit_cr, 'predicted' AS model_status FROM raw""")
def reloaded_base_terms(spark, sf_dir):
    ratios = settle(base_terms.impute(raw_ratios(spark, sf_dir)))
    train = ratios.withColumns({
        "base_rate": F.when(F.col("dscr") < 1, 12.0).otherwise(9.0), "base_limit": F.when(F.col("leverage_ratio") > 3.5, 5.0).otherwise(10.0)})
    folder = f"{shared_folder(spark)}/base-terms-{uuid.uuid4().hex}"
    version = base_terms.keep_base_terms(train, folder, trees=10)
    return base_terms.predict_base_terms(base_terms.load_base_terms(spark, folder, version), ratios)


@query("default_base_terms", """SELECT o_custkey AS applicant_id, CAST(9 AS DOUBLE) AS ml_base_rate_pct, CAST(10 AS DOUBLE) AS ml_base_limit_cr,
  'fallback_no_model' AS model_status FROM orders GROUP BY o_custkey""")
def default_base_terms(spark, sf_dir):
    return base_terms.predict_base_terms(None, raw_ratios(spark, sf_dir))


# --- Memo ----------------------------------------------------------------------------
@query("memo_proposal", f"""{dq.WITH_TRIGGERS}, chosen AS (SELECT * FROM trig), d AS ({dq.DECIDE_SQL.replace("folded AS (", "SELECT * FROM (WITH folded AS (")})),
r(line, item) AS (VALUES (1, 'Nature of Facility'), (2, 'Recommended Limit'), (3, 'Recommended Rate'), (4, 'Base Rate Applied'),
  (5, 'Base Limit Applied'), (6, 'Risk Penalties Applied'), (7, 'FINAL RECOMMENDATION'))
SELECT applicant_id, 2 AS section, line, item, CASE line WHEN 1 THEN 'Working Capital / Term Loan' WHEN 2 THEN '₹' || printf('%.2f', final_limit_cr)
  || ' Crore' WHEN 3 THEN printf('%.2f', final_rate_pct) || '% p.a.' WHEN 4 THEN '9.00% p.a.' WHEN 5 THEN '₹10.00 Crore'
  WHEN 6 THEN penalties_applied || ' rules | ' || total_bps || ' bps total' ELSE replace(recommendation, '_', ' ') END AS value
FROM d CROSS JOIN r""")
def memo_proposal(spark, sf_dir):
    return memo.proposal_rows(dq.decisions(spark, sf_dir))


@query("memo_banking", f"""WITH {TXNS.cte}, s AS (SELECT applicant_id, count(*) AS n, CAST(sum(credit) AS BIGINT) AS c, CAST(sum(debit) AS BIGINT) AS d,
  CAST(round(round(coalesce(avg(nullif(balance, 0)), 0), 2)) AS BIGINT) AS b FROM txns GROUP BY 1), r(line, item) AS (VALUES (20, 'Transactions Analyzed'), (21, 'Total Credits'), (22, 'Total Debits'),
  (23, 'Average Monthly Balance'))
SELECT applicant_id, 3 AS section, line, item, CASE line WHEN 20 THEN CAST(n AS VARCHAR) WHEN 21 THEN '₹' || format('{{:,}}', c)
  WHEN 22 THEN '₹' || format('{{:,}}', d) ELSE '₹' || format('{{:,}}', b) END AS value FROM s CROSS JOIN r""")
def memo_banking(spark, sf_dir):
    return memo.banking_rows(bank.statement_summary(TXNS.frame(spark, sf_dir)))


@query("memo_counterparties", f"""{nq.VOLUMES}, {nq.TOUCHED}, fc AS (SELECT applicant_id, count(*) AS flags,
  count(*) FILTER (WHERE flag_type = 'circular_loop') AS lf FROM touched GROUP BY 1),
n AS (SELECT r.applicant_id, count(*) AS e, count(*) FILTER (WHERE is_shell_suspect) AS sh, coalesce(max(lf), 0) AS lf,
  coalesce(max(flags), 0) AS fl FROM risk r LEFT JOIN fc USING (applicant_id) GROUP BY 1),
r(line, item) AS (VALUES (1, 'Counterparties Analyzed'), (2, 'Shell Company Suspects'), (3, 'Circular Trading Detected'),
  (4, 'Round-trip Flow Chains'), (5, 'Total Risk Flags'))
SELECT applicant_id, 5 AS section, line, item, CASE line WHEN 1 THEN CAST(e AS VARCHAR) WHEN 2 THEN CAST(sh AS VARCHAR)
  WHEN 3 THEN CASE WHEN lf > 0 THEN 'YES' ELSE 'NO' END WHEN 4 THEN CAST(lf AS VARCHAR) ELSE CAST(fl AS VARCHAR) END AS value
FROM n CROSS JOIN r""")
def memo_counterparties(spark, sf_dir):
    return memo.counterparty_rows(network.network_summary(nq.shells(spark, sf_dir), nq.touched(spark, sf_dir)))


def memo_parts(spark, sf_dir):
    t = vq.tables(spark, sf_dir)
    triggers, rules = dq.triggers(spark, sf_dir), decision.rule_table(spark)
    decided, people = dq.decisions(spark, sf_dir), dq._applicants(spark, sf_dir)
    scans = portfolio.latest_filings(FILINGS.frame(spark, sf_dir))
    yearly = financials.ratios(figures(spark, sf_dir))
    current = financials.best_per_group(yearly, ["applicant_id"], "fiscal_year", ["fiscal_year"])
    company = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("applicant_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("CIN"), "c_custkey").alias("cin"), F.lit(None).cast("date").alias("incorporated"),
        F.lit(None).cast("string").alias("address"), F.col("c_mktsegment").alias("activity"),
        F.lit("Active").alias("status"), (F.abs("c_acctbal") * 1000).alias("paid_up_capital"))
    # Each chain of joins is settled: together they would hold the sorted rows of a dozen tables in one task.
    facts = settle(t["audit"].join(t["registry"], "applicant_id", "left").join(t["courts"], "applicant_id", "left").join(
        t["news"], "applicant_id", "left").join(t["restated"], "applicant_id", "left").withColumn(
            "registry_found", F.col("epfo_compliance").isNotNull()))
    verdicts = settle(vq.verify.verdict_summary(vq.rolled(spark, sf_dir)))
    visits = prose.site_visit_scan(NOTES.frame(spark, sf_dir)).groupBy("applicant_id").agg(
        F.min("capacity_pct").alias("capacity_pct"))
    holders = company.select("applicant_id", F.array(F.col("activity")).alias("charge_holders"))
    told = filings.supply_narrative(filings.supply_scores(filings.supply_features(scans)))
    return [
        memo.profile_rows(company), memo.proposal_rows(decided), memo.financial_rows(current, t["restated"]),
        memo.banking_rows(bank.statement_summary(TXNS.frame(spark, sf_dir))),
        memo.reconciliation_rows(memo.reconciliation_memo(t["gst"], t["statement"])),
        memo.counterparty_rows(network.network_summary(nq.shells(spark, sf_dir), nq.touched(spark, sf_dir))),
        memo.supply_rows(told),
        memo.verification_rows(facts, verdicts),
        memo.collateral_rows(filings.collateral(scans), holders), memo.site_rows(visits),
        memo.matrix_rows(decision.risk_matrix(triggers, rules)),
        memo.recommendation_rows(decided, decision.conditions(triggers, people)), memo.committee_rows(people),
    ]


@query("memo_rows")
def memo_rows(spark, sf_dir):
    return memo.memo_rows(*memo_parts(spark, sf_dir))


# --- Whole portfolio -----------------------------------------------------------------
def portfolio_tables(spark, sf_dir):
    evidence = {k: v for k, v in vq.tables(spark, sf_dir).items() if k not in ("statement", "site")}
    outside = {
        "benchmark": network.benchmark_rules(nq.compared(spark, sf_dir)),
        "counterparty": network.network_rules(network.loop_flags(nq.loops(spark, sf_dir))),
        "purpose": network.loan_purpose(nq.APPLICATIONS.frame(spark, sf_dir), nq.spending_shares(spark, sf_dir))}
    return portfolio.appraise(
        TXNS.frame(spark, sf_dir), FILINGS.frame(spark, sf_dir), NOTES.frame(spark, sf_dir), evidence,
        figures(spark, sf_dir), auditors(spark, sf_dir), decision.rule_table(spark), pq.TONE, outside)


@query("portfolio_decisions")
def portfolio_decisions(spark, sf_dir):
    return portfolio_tables(spark, sf_dir)["decisions"].withColumn("triggered_rules", F.array_join("triggered_rules", ","))


RESULT_SQL = f"""{dq.WITH_TRIGGERS}, chosen AS (SELECT * FROM trig), d AS ({dq.DECIDE_SQL.replace("folded AS (", "SELECT * FROM (WITH folded AS (")})),
pen AS (SELECT applicant_id, count(*) AS n, string_agg(rule_id, ',' ORDER BY source_ord, rule_id) AS ids FROM trig JOIN rules USING (rule_id) GROUP BY 1)
SELECT applicant_id, final_rate_pct, final_limit_cr, recommendation, coalesce(n, 0) AS penalties, coalesce(ids, '') AS penalty_rules,
  verified, mismatched FROM d LEFT JOIN pen USING (applicant_id) LEFT JOIN vs USING (applicant_id)"""


RESULT_CHECK = f"""{vq.RANKED}, vs AS (SELECT applicant_id, count(*) FILTER (WHERE overall_status = 'MATCH') AS verified,
  count(*) FILTER (WHERE overall_status = 'MISMATCH') AS mismatched FROM rolled GROUP BY 1), {RESULT_SQL[len("WITH "):]}"""


def nested_results(spark, sf_dir):
    triggers, rules = dq.triggers(spark, sf_dir), decision.rule_table(spark)
    penalties = decision.apply_rules(triggers, rules).select(
        "applicant_id", "source_ord", "rule_id", "name", "trigger", "rate_penalty_bps", "limit_reduction_pct")
    verdicts = vq.rolled(spark, sf_dir)
    return portfolio.assemble_result(
        dq.decisions(spark, sf_dir), {"summary": vq.verify.verdict_summary(verdicts)},
        {"applied_penalties": (penalties, ["source_ord", "rule_id"]), "verifications": (verdicts, ["claim_id"])})


def flat_results(result):
    return result.select(
        "applicant_id", "final_rate_pct", "final_limit_cr", "recommendation",
        F.greatest(F.size("applied_penalties"), F.lit(0)).cast("bigint").alias("penalties"),
        F.coalesce(F.array_join(F.transform("applied_penalties", lambda p: p["rule_id"]), ","), F.lit("")).alias("penalty_rules"),
        F.col("summary.verified").alias("verified"), F.col("summary.mismatched").alias("mismatched"))


@query("appraisal_results", RESULT_CHECK)
def appraisal_results(spark, sf_dir):
    return flat_results(nested_results(spark, sf_dir))


@query("written_results", RESULT_CHECK)
def written_results(spark, sf_dir):
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    portfolio.write_results(nested_results(spark, sf_dir), path)
    return flat_results(spark.read.parquet(path))
