"""Bureau feeds: nested JSON read with fixed schemas, and their child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendgrain.session import settle

# Feed schemas, keyed by applicant.
SCHEMAS = {
    "gst": (
        "applicant_id BIGINT, status STRING, gstr_2a_3b_mismatch_pct DOUBLE, gst_filing_consistency STRING, "
        "gst_filing_discipline_score DOUBLE, gst_turnover_cr DOUBLE, "
        "gstr_3b_filings ARRAY<STRUCT<month STRING, status STRING, tax_paid_lakh DOUBLE, itc_claimed_lakh DOUBLE>>, "
        "top_suppliers_gstr2a ARRAY<STRUCT<name STRING, gstin STRING, invoice_value_lakh DOUBLE, itc_lakh DOUBLE>>"
    ),
    "registry": (
        "applicant_id BIGINT, status STRING, active_litigations ARRAY<STRING>, director_disqualified BOOLEAN, "
        "epfo_compliance STRING, charge_holders ARRAY<STRING>, "
        "directors ARRAY<STRUCT<name STRING, din STRING, designation STRING, appointment_date STRING>>, "
        "gst_registrations ARRAY<STRUCT<gstin STRING, state STRING, status STRING, registration_date STRING>>, "
        "compliance_timeline ARRAY<STRUCT<date STRING, event STRING, status STRING>>"
    ),
    "bureau": (
        "applicant_id BIGINT, status STRING, credit_score INT, rating STRING, dpd_30_count INT, dpd_60_count INT, "
        "dpd_90_count INT, suit_filed_amount_cr DOUBLE, "
        "facilities ARRAY<STRUCT<type STRING, lender STRING, sanctioned_cr DOUBLE, outstanding_cr DOUBLE, "
        "dpd_current INT, status STRING>>"
    ),
    "courts": (
        "applicant_id BIGINT, status STRING, cases_found INT, high_risk_cases INT, "
        "cases ARRAY<STRUCT<case_number STRING, court STRING, case_type STRING, filing_date STRING, parties STRING, "
        "status STRING, subject STRING, amount_cr DOUBLE>>, "
        "findings ARRAY<STRUCT<signal STRING, court STRING, filing_date STRING, severity STRING>>, "
        "triggered_rules ARRAY<STRING>"
    ),
    "news": (
        "applicant_id BIGINT, status STRING, articles_found INT, adverse_media_detected BOOLEAN, "
        "articles ARRAY<STRUCT<headline STRING, source STRING, published STRING, severity STRING, summary STRING>>, "
        "red_flags ARRAY<STRUCT<headline STRING, source STRING, severity STRING, summary STRING>>, "
        "triggered_rules ARRAY<STRING>"
    ),
    "graph": (
        "applicant_id BIGINT, circular_trading_detected BOOLEAN, "
        "nodes ARRAY<STRUCT<id STRING, label STRING, type STRING, amount_cr DOUBLE>>, "
        "links ARRAY<STRUCT<source STRING, target STRING, value DOUBLE, label STRING>>"
    ),
}


def read_feed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Feed files of one kind; the schema is given, so nothing is inferred."""
    return spark.read.schema(SCHEMAS[kind]).json(path)


def read_feed_checked(spark: SparkSession, kind: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Feed rows, and the lines that are not whole: damaged JSON, values of another type, or no applicant.

    Rows have the columns of the schema. Damaged lines (file, reason, line) go to whoever keeps the
    quarantine; nothing is dropped and nothing fails. The files are read once.
    """
    raw = spark.read.schema(f"{SCHEMAS[kind]}, _line STRING").option("columnNameOfCorruptRecord", "_line").json(path)
    columns = [c for c in raw.columns if c != "_line"]
    held = settle(raw.select("*", F.col("_metadata.file_path").alias("_file")))
    damaged, nameless = F.col("_line").isNotNull(), F.col("applicant_id").isNull()
    good = held.filter(~damaged & ~nameless).select(*columns)
    bad = held.filter(damaged | nameless).select(
        F.col("_file").alias("file"), F.when(damaged, "damaged").otherwise("no applicant").alias("reason"),
        F.coalesce("_line", F.to_json(F.struct(*columns))).alias("line"))
    return good, bad


def quarantine_counts(bad: DataFrame) -> DataFrame:
    """Lines in quarantine per file and reason."""
    return bad.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("lines"))


def parse_feed(payloads: DataFrame, kind: str, column: str = "payload") -> DataFrame:
    """Feed messages held as text in a column."""
    return payloads.select(F.from_json(column, SCHEMAS[kind]).alias("f")).select("f.*")


def children(feed: DataFrame, array: str) -> DataFrame:
    """Elements of a nested list as rows, numbered in their order."""
    return feed.select("applicant_id", F.posexplode(array).alias("pos", "c")).select("applicant_id", "pos", "c.*")


def gst_evidence(feed: DataFrame) -> DataFrame:
    """Tax feed as the checks read it; a failed call leaves no evidence."""
    return feed.filter("status = 'success'").select(
        "applicant_id", F.coalesce("gstr_2a_3b_mismatch_pct", F.lit(0.0)).alias("mismatch_pct"),
        F.coalesce("gst_turnover_cr", F.lit(0.0)).alias("turnover_cr"),
        F.coalesce("gst_filing_consistency", F.lit("Regular")).alias("filing_consistency"))


def registry_evidence(feed: DataFrame) -> DataFrame:
    return feed.filter("status = 'success'").select(
        "applicant_id", F.coalesce("director_disqualified", F.lit(False)).alias("director_disqualified"),
        F.coalesce("epfo_compliance", F.lit("Unknown")).alias("epfo_compliance"),
        F.coalesce("active_litigations", F.array().cast("array<string>")).alias("active_litigations"))


def bureau_evidence(feed: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return feed.filter("status = 'success'").select(
        "applicant_id", F.coalesce("credit_score", zero).alias("credit_score"), F.col("rating").alias("bureau_rating"),
        F.coalesce("dpd_30_count", zero).alias("dpd_30"), F.coalesce("dpd_90_count", zero).alias("dpd_90"),
        F.coalesce("suit_filed_amount_cr", F.lit(0.0)).alias("suit_filed_cr"))


def graph_edges(feed: DataFrame) -> DataFrame:
    """Money links of the entity graph and the applicant's node, for the loop search."""
    return children(feed, "links").select(
        "applicant_id", F.col("source").alias("src"), F.col("target").alias("dst"), "value")


def graph_anchors(feed: DataFrame) -> DataFrame:
    return children(feed, "nodes").filter("type = 'applicant'").select("applicant_id", F.col("id").alias("node"))
