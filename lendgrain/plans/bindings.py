"""Portfolio views over the supplied tables.

Each view is one select list both Spark and the checking engine read, so a query and
its check start from the same rows. Views only rename, derive and add passages over
their whole table. A ``where`` stands only where missing rows are the subject, as in
the fallback for applicants that a feed does not know.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendgrain.session import spread


# Tables whose rows cost much to process, with the columns of a unique key to spread them by.
COSTLY = {"documents": ("doc_id",), "events": ("event_id",), "conversations": ("conv_id", "turn")}


@dataclass(frozen=True)
class View:
    name: str
    table: str
    columns: tuple[str, ...]
    where: str | None = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        if self.table in COSTLY:
            rows = spread(rows, *COSTLY[self.table])
        if self.where:
            rows = rows.filter(self.where)
        return rows.selectExpr(*self.columns)

    @property
    def cte(self) -> str:
        where = f" WHERE {self.where}" if self.where else ""
        return f"{self.name} AS (SELECT {', '.join(self.columns)} FROM {self.table}{where})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(number: str) -> str:
    return f"CAST({number} AS STRING)"


DAY_TEXT = (
    "lpad(CAST(day(ts) AS STRING), 2, '0') || '-' || lpad(CAST(month(ts) AS STRING), 2, '0') || '-' || "
    "CAST(year(ts) AS STRING)"
)

# Bank transactions from the event stream: users are counterparties, 25 accounts.
TXNS = View("txns", "events", (
    "user_id % 25 AS applicant_id",
    "event_id AS seq",
    "ts",
    f"{DAY_TEXT} AS date_str",
    "CASE event_type "
    f"WHEN 'purchase' THEN 'UPI/DR/' || {text('event_id')} || '/PARTY ' || {text('user_id')} || '/PAY' "
    f"WHEN 'click' THEN 'NEFT Dr-' || {text('event_id')} || '-HDFC0001-PARTY ' || {text('user_id')} || '--' "
    f"WHEN 'view' THEN 'IMPS Cr-' || {text('event_id')} || '-PARTY ' || {text('user_id')} "
    f"WHEN 'signup' THEN 'CASH DEPOSIT CDM-' || {text('event_id')} || '-PARTY ' || {text('user_id')} "
    f"ELSE 'SERVICE CHARGE ' || {text('event_id')} END AS description",
    "CASE WHEN event_type IN ('purchase', 'click') THEN CAST(round(value * 1000) AS DOUBLE) "
    "ELSE CAST(0 AS DOUBLE) END AS debit",
    "CASE WHEN event_type IN ('view', 'signup') THEN CAST(round(value * 1000) AS DOUBLE) "
    "ELSE CAST(0 AS DOUBLE) END AS credit",
    "CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE CAST(round(value * 100) AS DOUBLE) END AS balance",
))
# The same with the counterparty, for checks.
PARTY_SQL = (
    "txnp AS (SELECT *, CASE WHEN description LIKE 'SERVICE%' THEN NULL "
    "ELSE regexp_extract(description, 'PARTY [0-9]+') END AS party FROM txns)"
)

# Yearly figures per customer from its orders.
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
FIGURE_SOURCES = [
    ("Revenue", "1 = 1"), ("EBITDA", "o_orderstatus = 'F'"), ("PAT", "o_orderstatus = 'O'"),
    ("Total Debt", "o_orderstatus = 'P'"), ("Net Worth", "o_orderpriority = '1-URGENT'"),
]


def figure_select(source: str = "orders") -> str:
    """Long figures with a comparative that restates some earlier values."""
    wide = ", ".join(
        f"CAST(sum(CASE WHEN {cond} THEN {CENTS} END) AS DOUBLE) / 100 AS f{i}"
        for i, (_, cond) in enumerate(FIGURE_SOURCES))
    long = " UNION ALL ".join(
        f"SELECT applicant_id, yr, '{name}' AS figure, f{i} AS value FROM fig_wide WHERE f{i} IS NOT NULL"
        for i, (name, _) in enumerate(FIGURE_SOURCES))
    return (
        f"fig_wide AS (SELECT o_custkey AS applicant_id, year(o_orderdate) AS yr, {wide} FROM {source} "
        "GROUP BY o_custkey, year(o_orderdate)), "
        f"fig_long AS ({long}), "
        "figures AS (SELECT applicant_id, 'FY' || CAST(yr AS STRING) AS fiscal_year, figure, value, "
        "lag(value) OVER (PARTITION BY applicant_id, figure ORDER BY yr) * "
        "(CASE (applicant_id + yr) % 4 WHEN 0 THEN 1.01 WHEN 1 THEN 1.05 WHEN 2 THEN 0.8 ELSE 1.0 END) "
        "AS previous_value FROM fig_long)"
    )


FIGURES_SQL = figure_select()


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of ``figure_select``; the yearly sums are made once and unfold inside their row."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("applicant_id"), F.year("o_orderdate").alias("yr"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    wide = orders.groupBy("applicant_id", "yr").agg(*[
        F.expr(f"CAST(sum(CASE WHEN {cond} THEN {CENTS} END) AS DOUBLE) / 100").alias(f"f{i}")
        for i, (_, cond) in enumerate(FIGURE_SOURCES)])
    long = wide.select("applicant_id", "yr", F.inline(F.array(*[
        F.struct(F.lit(name).alias("figure"), F.col(f"f{i}").alias("value")) for i, (name, _) in enumerate(FIGURE_SOURCES)])))
    return long.filter("value IS NOT NULL").selectExpr(
        "applicant_id", "'FY' || CAST(yr AS STRING) AS fiscal_year", "figure", "value",
        "lag(value) OVER (PARTITION BY applicant_id, figure ORDER BY yr) * "
        "(CASE (applicant_id + yr) % 4 WHEN 0 THEN 1.01 WHEN 1 THEN 1.05 WHEN 2 THEN 0.8 ELSE 1.0 END) AS previous_value")


# Auditor of each customer and year, rotating for some.
AUDITORS = View("auditor_rows", "orders", (
    "o_custkey AS applicant_id",
    "'FY' || CAST(year(o_orderdate) AS STRING) AS fiscal_year",
    "CASE (o_custkey + CASE WHEN o_custkey % 3 = 0 THEN CAST(floor(year(o_orderdate) / 2) AS BIGINT) ELSE 0 END) % 6 "
    "WHEN 0 THEN 'Gupta Sharma & Associates' WHEN 1 THEN 'Rao & Mehta LLP' WHEN 2 THEN 'SR Batliboi & Co LLP' "
    "WHEN 3 THEN 'Maxwell Patel LLP' WHEN 4 THEN 'Iyer Associates' ELSE '' END AS auditor",
))
AUDITORS_SQL = AUDITORS.cte + ", auditors AS (SELECT DISTINCT * FROM auditor_rows)"


def auditors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AUDITORS.frame(spark, sf_dir).distinct()


# Filings: each document with disclosure passages that vary by its number.
NEWLINE = "chr(10)"
PARAGRAPH = "chr(10) || chr(10)"
GRADE = (
    "(CASE doc_id % 6 WHEN 0 THEN 'AA+' WHEN 1 THEN 'BBB' WHEN 2 THEN 'BB-' WHEN 3 THEN 'AAA' WHEN 4 THEN 'D' "
    "ELSE 'A-' END)"
)
PASSAGES = [
    (None, f"'Revenue from operations for the year was ' || {text('1000 + doc_id * 37 % 90000')} || '.50 Cr'"),
    ("doc_id % 4 <> 1", f"'EBITDA stood at ' || {text('100 + doc_id * 13 % 700')} || '.25 cr for the period'"),
    ("doc_id % 5 <> 2", f"'Profit for the year amounting to ₹ (' || {text('1000 + doc_id * 7 % 5000')} || '.75)'"),
    ("doc_id % 3 <> 0", f"'Total borrowings were ₹ ' || {text('200 + doc_id * 11 % 3000')} || ' crore'"),
    ("doc_id % 3 <> 1", f"'Total equity stood at ₹ ' || {text('20000 + doc_id * 17 % 60000')} || ' million'"),
    ("doc_id % 5 = 0", "'Undisputed statutory dues including provident fund remain outstanding'"),
    ("doc_id % 7 = 0", "'Except for the matter above the statements give a true view.'"),
    ("doc_id % 11 = 0", "'There is material uncertainty related to going concern.'"),
    ("doc_id % 2 = 0", f"'Facilities rated CRISIL ' || {GRADE} || ' with outlook: stable'"),
    ("doc_id % 13 = 0", "'The rating was downgraded during the year'"),
    ("doc_id % 3 = 0", f"'Promoter holding: ' || {text('15 + doc_id % 60')} || '.5 % of which pledged ' || "
                       f"{text('doc_id % 80')} || '.25 %'"),
    ("doc_id % 9 = 0", "'The company availed unsecured loans from directors.'"),
    ("doc_id % 4 = 0", "'Working capital is secured by first charge on current assets.'"),
    ("doc_id % 6 = 0", "'Major suppliers include Alpha Metals, Beta Chem and Gamma Ltd.'"),
    ("doc_id % 8 = 0", f"'Top customer contributed ' || {text('10 + doc_id % 60')} || ' % of revenue.'"),
    ("doc_id % 10 = 0", "'There is no commodity exposure.'"),
    ("doc_id % 10 = 5", "'Commodity prices rose; monsoon was weak.'"),
    ("doc_id % 12 = 0", "'Trade receivables increased. Receivable days increased from 60 to 85.'"),
    ("doc_id % 12 = 6", "'Sales are via small buyers with delayed payment.'"),
    ("doc_id % 14 = 0", "'Principal products: sacks, films and yarn; tape.'"),
    ("doc_id % 2 = 1", f"'For Firm ' || (CASE doc_id % 5 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Gamma' END) || "
                       "' Associates'"),
]


def filing_text(base: str = "text") -> str:
    parts = [base, PARAGRAPH]
    for condition, passage in PASSAGES:
        piece = f"{passage} || {PARAGRAPH}"
        parts.append(piece if condition is None else f"CASE WHEN {condition} THEN {piece} ELSE '' END")
    return " || ".join(parts)


FILINGS = View("filings", "documents", (
    "doc_id", "doc_id % 500 AS applicant_id", "'FY' || CAST(2019 + doc_id % 6 AS STRING) AS fiscal_year",
    f"{filing_text()} AS text",
))
DOCS = View("docs", "documents", ("doc_id", "lang", "source", "text"))

# Site notes: conversation turns with field observations.
NOTES = View("notes", "conversations", (
    "conv_id * 100 + turn AS note_id", "conv_id AS applicant_id",
    "text || ' ' || CASE (conv_id + turn) % 9 "
    f"WHEN 0 THEN 'Plant running at ' || {text('30 + conv_id % 60')} || '% of load. Factory closed.' "
    f"WHEN 1 THEN 'Saw ' || {text('20 + conv_id % 70')} || ' % capacity in use; machinery idle.' "
    "WHEN 2 THEN 'Workers on strike, premises vacant.' WHEN 3 THEN 'Management evasive, books not available.' "
    "WHEN 4 THEN 'Excess stock and poor maintenance seen.' WHEN 5 THEN 'Sole decision maker; records maintained.' "
    "WHEN 6 THEN 'Unsold goods. Equipment obsolete. No orders.' WHEN 7 THEN 'All fine, account closed account.' "
    "ELSE '' END AS notes",
))
