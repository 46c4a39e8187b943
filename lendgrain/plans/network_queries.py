"""Screening and network queries over counterparties, registry records and money flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions.party import with_party
from lendgrain.operators import bank, network
from lendgrain.plans.bindings import AUDITORS_SQL, PARTY_SQL, TXNS, View, auditors
from lendgrain.plans.registry import query
from lendgrain.session import settle

LISTS = ", ".join("('{}', '{}')".format(t, f.replace("'", "''")) for t, f, _, _ in fv.AUDITOR_LISTS)


@query("screened_auditors", f"""WITH {AUDITORS_SQL}, lists(list_type, firm) AS (VALUES {LISTS}),
h AS (SELECT a.applicant_id, a.fiscal_year, a.auditor, count(l.firm) AS records,
  coalesce(bool_or(l.list_type = 'BLACKLISTED'), false) AS blacklisted, coalesce(bool_or(l.list_type = 'WATCHLIST'), false) AS watchlisted
  FROM auditors a LEFT JOIN lists l ON a.auditor <> '' AND (contains(upper(a.auditor), upper(l.firm))
    OR contains(upper(l.firm), upper(a.auditor))) GROUP BY 1, 2, 3)
SELECT *, CASE WHEN auditor = '' THEN 'NOT_CHECKED' WHEN blacklisted THEN 'BLACKLISTED' WHEN watchlisted THEN 'WATCHLIST'
  ELSE 'CLEAR' END AS status, CASE WHEN auditor = '' THEN 'No auditor name extracted from annual report'
  WHEN blacklisted THEN 'ALERT: ' || auditor || ' appears on institutional blacklist'
  WHEN watchlisted THEN 'NOTICE: ' || auditor || ' is on enhanced monitoring watchlist'
  ELSE auditor || ' — no adverse records found in institutional memory' END AS message FROM h""")
def screened_auditors(spark, sf_dir):
    lists = spark.createDataFrame(fv.AUDITOR_LISTS, fv.AUDITOR_LIST_SCHEMA)
    return network.screen_auditors(auditors(spark, sf_dir), lists)


# Registry: one record per customer; the parties of the statements are its names, but for renamed ones.
REGISTRY = View("registry", "customer", (
    "CASE WHEN c_custkey % 5 = 2 THEN 'Former ' ELSE '' END || 'Party-' || CAST(c_custkey AS STRING) AS name", "'CIN' || CAST(c_custkey AS STRING) AS cin",
    "CASE c_custkey % 6 WHEN 0 THEN 'Struck Off' WHEN 3 THEN 'Dormant' ELSE 'Active' END AS company_status",
    "CASE WHEN c_custkey % 7 = 0 THEN 'c/o Virtual Office ' ELSE 'Plot ' END || CAST(c_nationkey AS STRING) AS registered_address",
    "abs(c_acctbal) * 100 AS paid_up_capital",
    "'Director ' || CAST(c_custkey % 40 AS STRING) || ' ' || c_mktsegment AS director"))
VOLUMES = f"""WITH {TXNS.cte}, {PARTY_SQL}, {REGISTRY.cte}, v AS (SELECT applicant_id, party, sum(debit) AS d, sum(credit) AS c,
  count(*) AS n, min(seq) AS s FROM txnp WHERE party IS NOT NULL GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY d + c DESC, s) AS rk FROM v) WHERE rk <= 10),
prof AS (SELECT t.applicant_id, t.party, d + c AS total_volume, r.cin, r.company_status, r.registered_address, r.paid_up_capital,
  r.director, r.cin IS NOT NULL AS registry_found FROM top t LEFT JOIN registry r ON upper(replace(r.name, '-', ' ')) = t.party),
shells AS (SELECT *, list_filter([CASE WHEN paid_up_capital < 100000 THEN 'Low paid-up capital' END,
  CASE WHEN upper(company_status) IN ('STRUCK OFF', 'DORMANT') THEN 'Company status: ' || company_status END,
  CASE WHEN regexp_matches(upper(registered_address), 'VIRTUAL|C/O') THEN 'Shared or virtual address' END],
  lambda x: x IS NOT NULL) AS why FROM prof)"""


def profiles(spark, sf_dir):
    top = bank.top_counterparties(bank.counterparty_volumes(with_party(TXNS.frame(spark, sf_dir))))
    return network.profile_counterparties(
        top.select("applicant_id", "party", "total_volume"), REGISTRY.frame(spark, sf_dir))


def shells(spark, sf_dir):
    return network.shell_suspects(profiles(spark, sf_dir))


@query("counterparty_profiles", f"{VOLUMES} SELECT * FROM prof")
def counterparty_profiles(spark, sf_dir):
    return profiles(spark, sf_dir)


@query("shell_suspects", f"""{VOLUMES} SELECT applicant_id, party, array_to_string(why, '; ') AS shell_reasons,
  len(why) > 0 AS is_shell_suspect FROM shells""")
def shell_suspects(spark, sf_dir):
    return shells(spark, sf_dir).select(
        "applicant_id", "party", F.array_join("shell_reasons", "; ").alias("shell_reasons"), "is_shell_suspect")


# Entities: the customers of a nation around its first one, which is the applicant.
ENTITIES = View("ents", "customer", (
    "CAST(c_nationkey AS BIGINT) AS applicant_id", "CASE WHEN c_custkey < 25 THEN 'applicant' ELSE 'counterparty' END AS role",
    "c_name AS entity", "'Rao ' || CAST(c_custkey % 90 AS STRING) || ' ' || c_mktsegment AS d1",
    "'Das ' || CAST(c_custkey % 70 AS STRING) || ' Shah' AS d2",
    "CASE WHEN c_custkey % 3 = 0 THEN 'No. ' || CAST(c_custkey % 50 AS STRING) || ', Ring Road' END AS address"))
FLAGS = f"""WITH {ENTITIES.cte}, ppl AS (SELECT applicant_id, role, entity, upper(d1) AS v FROM ents
  UNION ALL SELECT applicant_id, role, entity, upper(d2) FROM ents),
held AS (SELECT DISTINCT applicant_id, role, entity, v, 'shared_director' AS flag_type, 'HIGH' AS severity FROM ppl
  UNION ALL SELECT DISTINCT applicant_id, role, entity, regexp_extract(v, '([^ ]+)$', 1), 'family_name', 'LOW' FROM ppl
  UNION ALL SELECT DISTINCT applicant_id, role, entity, trim(regexp_replace(regexp_replace(upper(address), '[^A-Z0-9 ]', ' ', 'g'),
    ' +', ' ', 'g')), 'same_address', 'MEDIUM' FROM ents WHERE address IS NOT NULL),
hub AS (SELECT *, first_value(entity) OVER w AS entity_a FROM held
  WINDOW w AS (PARTITION BY applicant_id, flag_type, v ORDER BY role <> 'applicant', entity)),
flags AS (SELECT applicant_id, flag_type, severity, entity_a, entity AS entity_b, v AS evidence FROM hub WHERE entity <> entity_a)"""


def relations(spark, sf_dir):
    rows = ENTITIES.frame(spark, sf_dir).withColumn("directors", F.array("d1", "d2")).drop("d1", "d2")
    return network.relationship_flags(rows)


@query("relationship_flags", f"{FLAGS} SELECT * FROM flags")
def relationship_flags(spark, sf_dir):
    return relations(spark, sf_dir)


# Money graph per market segment: customer nation pays supplier nation.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SEGMENT_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(SEGMENTS)) + " ELSE 0 END"
EDGES = f"""flow AS (SELECT CAST({SEGMENT_SQL} AS BIGINT) AS applicant_id,
  CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
walks AS (SELECT applicant_id, [src, dst] AS path, least(f.value, b.value) AS loop_value FROM flow f
    JOIN (SELECT applicant_id, src AS dst, dst AS src, value FROM flow) b USING (applicant_id, src, dst)
  UNION ALL SELECT a.applicant_id, [a.src, a.dst, m.dst], least(a.value, m.value, z.value) FROM flow a
    JOIN flow m ON m.applicant_id = a.applicant_id AND m.src = a.dst AND m.dst <> a.src
    JOIN flow z ON z.applicant_id = a.applicant_id AND z.src = m.dst AND z.dst = a.src),
lo AS (SELECT *, list_contains(path, applicant_id) AS through_applicant FROM walks
  WHERE path[1] = CASE WHEN list_contains(path, applicant_id) THEN applicant_id ELSE list_min(path) END)"""


def flow_edges(spark, sf_dir):
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    lines = read("lineitem", "l_orderkey", "l_suppkey", "l_extendedprice")
    customers = read("customer", "c_custkey", "c_mktsegment", "c_nationkey")
    # Customers of an order first, so that only two narrow columns travel on with the lines.
    buyers = read("orders", "o_orderkey", "o_custkey").join(
        customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "c_nationkey")
    sold = lines.join(read("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    paid = sold.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "c_mktsegment", "c_nationkey", "s_nationkey").agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double").alias("value"))
    return paid.filter("c_nationkey <> s_nationkey").select(
        F.expr(SEGMENT_SQL).cast("bigint").alias("applicant_id"), F.col("c_nationkey").cast("bigint").alias("src"),
        F.col("s_nationkey").cast("bigint").alias("dst"), "value")


def loops(spark, sf_dir):
    edges = settle(flow_edges(spark, sf_dir))  # a row per segment and pair of nations at most, read four times
    anchors = edges.select("applicant_id").distinct().withColumn("node", F.col("applicant_id"))
    return network.circular_loops(edges, anchors)


@query("circular_loops", f"""WITH {EDGES} SELECT applicant_id, array_to_string(path, '>') AS path, loop_value,
  CAST(len(path) AS INTEGER) AS length, through_applicant FROM lo""")
def circular_loops(spark, sf_dir):
    return loops(spark, sf_dir).withColumn("path", F.array_join("path", ">"))


LOOP_FLAGS = """lf AS (SELECT applicant_id, 'circular_loop' AS flag_type, 'CRITICAL' AS severity, CAST(path[1] AS VARCHAR) AS entity_a,
  CAST(unnest(path[2:3]) AS VARCHAR) AS entity_b, array_to_string(path, ' -> ') AS evidence FROM lo)"""


@query("loop_flags", f"WITH {EDGES}, {LOOP_FLAGS} SELECT * FROM lf")
def loop_flags(spark, sf_dir):
    return network.loop_flags(loops(spark, sf_dir)).withColumns({
        c: F.col(c).cast("string") for c in ("entity_a", "entity_b")})


@query("network_rules", f"""WITH {EDGES}, {LOOP_FLAGS} SELECT applicant_id, count(*) AS flags, true AS circular_trading_detected,
  'P-06' AS triggered_rules FROM lf GROUP BY 1""")
def network_rules(spark, sf_dir):
    return network.network_rules(network.loop_flags(loops(spark, sf_dir))).withColumn(
        "triggered_rules", F.array_join("triggered_rules", ","))


# Flags on statement counterparties: each transaction of an odd counterparty is one.
TOUCHED = """touched AS (SELECT applicant_id, CASE WHEN seq % 50 = 1 THEN 'circular_loop' ELSE 'same_address' END AS flag_type,
  CASE seq % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  'APPLICANT' AS entity_a, party AS entity_b FROM txnp WHERE party IS NOT NULL),
seen AS (SELECT applicant_id, entity_b AS party, count(*) AS flag_count, bool_or(flag_type = 'circular_loop') AS in_loop,
  ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][min(list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity))] AS worst FROM touched
  GROUP BY 1, 2),
risk AS (SELECT s.applicant_id, s.party, len(why) > 0 AS is_shell_suspect, registry_found, coalesce(flag_count, 0) AS flag_count,
  coalesce(in_loop, false) AS in_loop, coalesce(worst, 'LOW') AS worst_severity FROM shells s LEFT JOIN seen USING (applicant_id, party))"""


def touched(spark, sf_dir):
    return with_party(TXNS.frame(spark, sf_dir)).filter("party IS NOT NULL").select(
        "applicant_id", F.when(F.col("seq") % 50 == 1, "circular_loop").otherwise("same_address").alias("flag_type"),
        F.element_at(F.array(*map(F.lit, ["LOW", "CRITICAL", "MEDIUM", "HIGH"])), (F.col("seq") % 4 + 1).cast("int"))
        .alias("severity"), F.lit("APPLICANT").alias("entity_a"), F.col("party").alias("entity_b"))


RISK_COLUMNS = ["applicant_id", "party", "is_shell_suspect", "registry_found", "flag_count", "in_loop", "worst_severity"]


@query("profile_risk", f"{VOLUMES}, {TOUCHED} SELECT * FROM risk")
def profile_risk(spark, sf_dir):
    return network.profile_risk(shells(spark, sf_dir), touched(spark, sf_dir)).select(*RISK_COLUMNS)


@query("ranked_profiles", f"""{VOLUMES}, {TOUCHED} SELECT applicant_id, party, CAST(row_number() OVER (PARTITION BY applicant_id
  ORDER BY in_loop DESC, is_shell_suspect DESC, flag_count DESC, party) AS INTEGER) AS rank FROM risk""")
def ranked_profiles(spark, sf_dir):
    risk = network.profile_risk(shells(spark, sf_dir), touched(spark, sf_dir))
    return network.rank_profiles(risk).select("applicant_id", "party", "rank")


@query("network_summary", f"""{VOLUMES}, {TOUCHED}, fc AS (SELECT applicant_id, count(*) AS flags,
  count(*) FILTER (WHERE flag_type = 'circular_loop') AS loop_flags FROM touched GROUP BY 1)
SELECT r.applicant_id, count(*) AS entities, count(*) FILTER (WHERE registry_found) AS registry_hits,
  count(*) FILTER (WHERE is_shell_suspect) AS shells, coalesce(max(loop_flags), 0) AS loop_flags, coalesce(max(flags), 0) AS flags
FROM risk r LEFT JOIN fc USING (applicant_id) GROUP BY 1""")
def network_summary(spark, sf_dir):
    return network.network_summary(shells(spark, sf_dir), touched(spark, sf_dir))


# Sector benchmark: a customer's balance against the mean of its segment.
BALANCES = View("ratios", "customer", (
    "c_custkey AS applicant_id", "CASE WHEN c_custkey % 10 = 0 THEN 'OTHER' ELSE c_mktsegment END AS sector",
    "'ebitda_margin' AS metric", "c_acctbal AS company_value", "CAST(round(c_acctbal * 100) AS BIGINT) AS cents"))
SECTOR = f"""WITH {BALANCES.cte}, sectors AS (SELECT sector, sum(cents) / CAST(100 AS DOUBLE) / count(*) AS b FROM ratios WHERE sector <> 'OTHER'
  GROUP BY 1 UNION ALL SELECT 'DEFAULT', sum(cents) / CAST(100 AS DOUBLE) / count(*) FROM ratios),
d AS (SELECT r.applicant_id, coalesce(s.sector, 'DEFAULT') AS sector_used, metric, company_value,
  coalesce(s.b, (SELECT b FROM sectors WHERE sector = 'DEFAULT')) AS bv FROM ratios r LEFT JOIN sectors s ON r.sector = s.sector),
o AS (SELECT *, (company_value - bv) / abs(bv) * 100 AS off FROM d),
cmp AS (SELECT applicant_id, sector_used, metric, company_value, round(bv, 6) AS benchmark_value, round(off, 4) AS deviation_pct,
  CASE WHEN off < -25 THEN 'CRITICAL' WHEN off < -10 THEN 'BELOW' ELSE 'OK' END AS status FROM o)"""


def compared(spark, sf_dir):
    rows = BALANCES.frame(spark, sf_dir)
    mean = (F.sum("cents") / F.lit(100.0) / F.count(F.lit(1))).alias("benchmark_value")
    by_sector = rows.filter("sector <> 'OTHER'").groupBy("sector", "metric").agg(mean)
    overall = rows.groupBy("metric").agg(mean).select(F.lit("DEFAULT").alias("sector"), "metric", "benchmark_value")
    return network.benchmark(rows.drop("cents"), by_sector.unionByName(overall))


@query("sector_benchmark", f"{SECTOR} SELECT * FROM cmp")
def sector_benchmark(spark, sf_dir):
    return compared(spark, sf_dir).withColumn("benchmark_value", F.round("benchmark_value", 6))


@query("benchmark_rules", f"""{SECTOR} SELECT applicant_id, count(*) FILTER (WHERE status = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE status = 'BELOW') AS below, CASE WHEN bool_or(status = 'CRITICAL') THEN 'P-30' ELSE '' END AS triggered_rules
FROM cmp GROUP BY 1""")
def benchmark_rules(spark, sf_dir):
    return network.benchmark_rules(compared(spark, sf_dir)).withColumn("triggered_rules", F.array_join("triggered_rules", ","))


FOUND = View("court_feed", "customer", (
    "c_custkey AS applicant_id", "c_custkey % 4 AS cases_found", "c_custkey % 2 AS high_risk_cases"), where="c_custkey % 3 <> 0")


@query("court_fallback", f"""WITH {FOUND.cte} SELECT c_custkey AS applicant_id, CASE WHEN f.cases_found > 0 THEN f.cases_found ELSE 3 END
  AS cases_found, CASE WHEN f.cases_found > 0 THEN f.high_risk_cases ELSE 1 END AS high_risk_cases,
  NOT coalesce(f.cases_found > 0, false) AS is_fallback FROM customer LEFT JOIN court_feed f ON c_custkey = f.applicant_id""")
def court_fallback(spark, sf_dir):
    default = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("applicant_id"), F.lit(3).cast("bigint").alias("cases_found"),
        F.lit(1).cast("bigint").alias("high_risk_cases"))
    return network.with_fallback(FOUND.frame(spark, sf_dir), default, F.col("cases_found") == 0)


# Loan purpose: spending shares of a customer from the priority of its orders.
SPENDING = View("spending", "orders", (
    "o_custkey AS applicant_id", "CASE o_orderpriority WHEN '1-URGENT' THEN 'Related Party Transfers' "
    "WHEN '2-HIGH' THEN 'Real Estate / Property' WHEN '3-MEDIUM' THEN 'Vendor Payments (Raw Materials)' "
    "WHEN '4-NOT SPECIFIED' THEN 'Unclassified / Cash Withdrawals' ELSE 'Salary & Wages' END AS category",
    "CAST(round(o_totalprice * 100) AS BIGINT) AS cents"))
APPLICATIONS = View("apps", "customer", (
    "c_custkey AS applicant_id", "CASE c_custkey % 3 WHEN 0 THEN 'Working Capital for mills' WHEN 1 THEN 'Office purchase' "
    "ELSE 'Manufacturing line' END AS stated_purpose",
    "CASE c_custkey % 4 WHEN 0 THEN 'Manufacture of textiles' WHEN 1 THEN 'Steel trade' ELSE 'Retail' END AS activity"))
SHARES = f"""WITH {SPENDING.cte}, {APPLICATIONS.cte}, cat AS (SELECT applicant_id, category, CAST(sum(cents) AS BIGINT) AS cents FROM spending
  GROUP BY 1, 2), tot AS (SELECT applicant_id, CAST(sum(cents) AS BIGINT) AS total FROM cat GROUP BY 1),
shares AS (SELECT applicant_id, category, CAST(cents * 1000 // total AS DOUBLE) / 10 AS pct FROM cat JOIN tot USING (applicant_id))"""


def spending_shares(spark, sf_dir):
    by_category = SPENDING.frame(spark, sf_dir).groupBy("applicant_id", "category").agg(F.sum("cents").alias("cents"))
    total = by_category.groupBy("applicant_id").agg(F.sum("cents").alias("total"))
    return by_category.join(total, "applicant_id").select(
        "applicant_id", "category", (F.floor(F.col("cents") * 1000 / F.col("total")).cast("double") / 10).alias("pct"))


@query("loan_purpose", f"""{SHARES}, w AS (SELECT applicant_id, {", ".join(
  f"coalesce(max(CASE WHEN category = '{c}' THEN pct END), 0) AS {a}" for c, a in [
    ("Related Party Transfers", "rel"), ("Real Estate / Property", "est"), ("Vendor Payments (Raw Materials)", "ven"),
    ("Unclassified / Cash Withdrawals", "unc")])} FROM shares GROUP BY 1),
j AS (SELECT a.*, coalesce(w.rel, 0.0::DOUBLE) AS rel, coalesce(w.est, 0.0::DOUBLE) AS est, coalesce(w.ven, 0.0::DOUBLE) AS ven,
  coalesce(w.unc, 0.0::DOUBLE) AS unc, regexp_matches(lower(stated_purpose), 'working capital|operational|manufacturing') AS wc
  FROM apps a LEFT JOIN w USING (applicant_id)),
s AS (SELECT *, CASE WHEN (wc AND est > 10) OR rel > 25 THEN 'MISMATCH' WHEN rel > 15 OR (wc AND ven < 35) OR unc > 10
  THEN 'PARTIAL_MISMATCH' ELSE 'MATCH' END AS overall_status,
  regexp_matches(lower(activity), 'textile|manufactur|steel|chemical|pharma') AND regexp_matches(lower(stated_purpose),
  'working capital|manufactur|operational') AS aligned FROM j)
, f AS (SELECT applicant_id, stated_purpose, activity, overall_status, concat_ws(',',
  CASE WHEN rel > 15 THEN 'HIGH_RELATED_PARTY_OUTFLOW/' || CASE WHEN rel > 25 THEN 'HIGH' ELSE 'MEDIUM' END || '/' || rel ||
    '% of bank outflows directed to related parties — inconsistent with stated working capital purpose/' || rel || '%' END,
  CASE WHEN wc AND est > 10 THEN 'FUND_DIVERSION_REAL_ESTATE/HIGH/' || est ||
    '% of funds routed to real estate/property despite stated purpose being working capital/' || est || '%' END,
  CASE WHEN wc AND ven < 35 THEN 'LOW_OPERATIONAL_SPEND/MEDIUM/Only ' || ven ||
    '% of outflows to vendors/raw materials — expected >50% for genuine working capital usage/' || ven || '%' END,
  CASE WHEN unc > 10 THEN 'HIGH_UNCLASSIFIED_OUTFLOWS/MEDIUM/' || unc ||
    '% of outflows are unclassified or cash withdrawals — cannot verify end-use/' || unc || '%' END)
  AS flags, list_filter([CASE WHEN rel > 15 THEN 'High Related Party Outflow' END, CASE WHEN wc AND est > 10 THEN 'Fund Diversion Real Estate' END,
    CASE WHEN wc AND ven < 35 THEN 'Low Operational Spend' END, CASE WHEN unc > 10 THEN 'High Unclassified Outflows' END],
    lambda x: x IS NOT NULL)[1:2] AS top, CASE overall_status
  WHEN 'MATCH' THEN 'Fund utilization pattern is consistent with the stated purpose: ''' || stated_purpose || ''''
  WHEN 'PARTIAL_MISMATCH' THEN 'Partial concerns detected — ' || array_to_string(top, ', ') || '. Recommend enhanced monitoring of fund end-use.'
  ELSE 'Significant fund diversion signals — ' || array_to_string(top, ', ') || '. Recommend end-use audit before disbursement.' END AS verdict,
  (SELECT array_to_string(list(category || ':' || pct ORDER BY pct DESC, category), ',') FROM shares WHERE shares.applicant_id = s.applicant_id)
    AS fund_utilization,
  CASE WHEN aligned THEN 'Stated purpose consistent with MCA activity: ''' ELSE 'Stated purpose may not align with MCA activity: ''' END
    || CASE activity WHEN 'Manufacture of textiles' THEN 'Manufacture Of Textiles' WHEN 'Steel trade' THEN 'Steel Trade'
      ELSE activity END || '''' AS alignment_detail, aligned, CASE WHEN overall_status = 'MISMATCH' THEN 'P-34' ELSE '' END AS triggered_rules
FROM s) SELECT * EXCLUDE (top) FROM f""")
def loan_purpose(spark, sf_dir):
    found = network.loan_purpose(APPLICATIONS.frame(spark, sf_dir), spending_shares(spark, sf_dir))
    return found.withColumns({
        "flags": F.array_join(F.transform("flags", lambda f: F.concat_ws(
            "/", f["flag"], f["severity"], f["detail"], f["ground_truth_value"])), ","),
        "fund_utilization": F.array_join(F.transform("fund_utilization", lambda u: F.concat_ws(":", u["category"], u["percentage"])), ","),
        "triggered_rules": F.array_join("triggered_rules", ",")})


@query("ranked_categories", f"""{SHARES} SELECT applicant_id, category, pct, CAST(row_number() OVER (PARTITION BY applicant_id
  ORDER BY pct DESC, category) AS INTEGER) AS rank FROM shares""")
def ranked_categories(spark, sf_dir):
    return network.rank_categories(spending_shares(spark, sf_dir))
