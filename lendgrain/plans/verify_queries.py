"""Verification queries: claims and evidence derived per customer from its orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendgrain.operators import memo, verify
from lendgrain.plans.bindings import View
from lendgrain.plans.registry import query
from lendgrain.session import settle

# Order facts from which claims and evidence derive.
FACTS = View("facts_raw", "orders", (
    "o_custkey AS applicant_id", "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
    "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f", "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o",
    "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS p",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS u"))
FACT_SQL = FACTS.cte + """, facts AS (SELECT applicant_id, CAST(sum(cents) AS BIGINT) AS c, CAST(sum(f) AS BIGINT) AS f,
  CAST(sum(o) AS BIGINT) AS o, CAST(sum(p) AS BIGINT) AS p, CAST(sum(u) AS BIGINT) AS u, count(*) AS n
  FROM facts_raw GROUP BY applicant_id)"""

# Each derived table: name, columns over facts, condition for having a row.
DERIVED = {
    "figs": ("CASE WHEN n % 10 = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(c AS DOUBLE) / 100000000 END AS revenue, "
             "CASE WHEN f > 2 THEN CAST(f AS DOUBLE) * 1.5 END AS ebitda, CASE WHEN o > 2 THEN CAST(o AS DOUBLE) * -2.5 END AS pat",
             "n % 17 <> 0"),
    "audit": ("f % 4 = 0 AS caro_default_found, o % 5 = 0 AS adverse_opinion_found, p % 4 = 0 AS emphasis_of_matter_found",
              "n > 0"),
    "holding": ("CASE WHEN n % 11 <> 0 THEN CAST(15 + c % 50 AS DOUBLE) END AS promoter_holding_pct, "
                "CASE WHEN n % 5 <> 0 THEN CAST(c % 80 AS DOUBLE) END AS pledged_pct", "n % 6 <> 1"),
    "rating": ("CASE WHEN n % 7 <> 0 THEN CASE c % 4 WHEN 0 THEN 'AA+' WHEN 1 THEN 'BBB' WHEN 2 THEN 'BB-' ELSE 'C' END END "
               "AS latest_rating, 'CRISIL' AS latest_agency, c % 4 < 2 AS is_investment_grade, u % 2 = 0 AS downgrade_detected",
               "n > 0"),
    "tone": ("CASE WHEN n % 5 <> 0 THEN 'success' ELSE 'insufficient_text' END AS status, "
             "CAST(c % 100 - 50 AS DOUBLE) / 1000 AS sentiment_score", "n > 0"),
    "restated": ("n % 3 = 0 AS restatements_detected, u % 2 = 0 AS auditor_changed", "n % 4 <> 0"),
    "statement": ("CASE WHEN n % 13 = 0 THEN 0 ELSE n END AS total_transactions, "
                  "CASE WHEN n % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c AS DOUBLE) / 10 * (6 + c % 6) / 10 END AS total_credits, "
                  "u AS cash_spikes", "n % 9 <> 8"),
    "gst": ("CAST(c % 20 AS DOUBLE) AS mismatch_pct, CASE WHEN n % 12 = 5 THEN CAST(0 AS DOUBLE) ELSE CAST(c AS DOUBLE) / 100000000 "
            "END AS turnover_cr, CASE WHEN u % 2 = 0 THEN 'Regular' ELSE 'Irregular' END AS filing_consistency", "n % 9 <> 0"),
    "bench": ("CASE WHEN n % 8 <> 1 THEN 'FMCG' END AS sector, CASE WHEN n % 5 <> 1 THEN CAST(c % 60 - 45 AS DOUBLE) END AS deviation_pct",
              "n > 0"),
    "bureau": ("f % 3 AS dpd_30, CASE WHEN o % 4 = 0 THEN 1 ELSE 0 END AS dpd_90, "
               "CASE WHEN p % 5 = 0 THEN CAST(3.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS suit_filed_cr, c % 100 AS credit_score, "
               "CASE c % 5 WHEN 0 THEN 'aa+' WHEN 1 THEN 'BB -' WHEN 2 THEN 'AAA' WHEN 3 THEN 'C' ELSE '' END AS bureau_rating",
               "n % 10 <> 9"),
    "registry": ("u % 4 = 1 AS director_disqualified, CASE c % 3 WHEN 0 THEN 'Regular' WHEN 1 THEN 'Unknown' ELSE 'Delayed' END "
                 "AS epfo_compliance, n % 3 AS suits", "n % 8 <> 7"),
    "news": ("f % 2 = 0 AS adverse_media_detected", "n % 7 <> 6"),
    "courts": ("n % 4 AS cases_found, CASE WHEN n % 4 > 1 AND u % 2 = 0 THEN 1 ELSE 0 END AS high_risk_cases", "n % 6 <> 5"),
    "site": ("u % 4 AS site_findings", "n % 5 <> 4"),
}
DERIVED_SQL = ", ".join(
    f"{name} AS (SELECT applicant_id, {columns} FROM facts WHERE {where})" for name, (columns, where) in DERIVED.items())
# Red-flag articles: every order of a customer is one.
ARTICLES = View("articles", "orders", (
    "o_custkey AS applicant_id",
    "CASE o_orderkey % 31 WHEN 0 THEN 'NCLT admits plea' WHEN 4 THEN 'Winding up petition' ELSE 'Probe widens' END AS headline",
    "CASE WHEN o_orderkey % 37 = 2 THEN 'Fears of closure' ELSE 'Shares fall' END AS summary"))
BASE = f"WITH {FACT_SQL}, {DERIVED_SQL}, {ARTICLES.cte}"


def tables(spark, sf_dir):
    """Tables of claims and evidence. The facts they all derive from are settled, so orders are summed once."""
    facts = settle(FACTS.frame(spark, sf_dir).groupBy("applicant_id").agg(
        F.sum("cents").alias("c"), *[F.sum(k).alias(k) for k in "fopu"], F.count(F.lit(1)).alias("n")))
    made = {name: facts.filter(where).selectExpr("applicant_id", *_split(columns))
            for name, (columns, where) in DERIVED.items()}
    suits = F.slice(F.array(F.lit("Section 138 complaint"), F.lit("Recovery suit")), F.lit(1), F.col("suits").cast("int"))
    made["registry"] = made["registry"].withColumn("active_litigations", suits).drop("suits")
    made["benchmark"] = made["bench"]
    made["red_flags"] = ARTICLES.frame(spark, sf_dir)
    made["facts"] = facts
    return made


def _split(columns: str) -> list[str]:
    """Top-level comma-separated expressions."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [c.strip() for c in out + [columns[start:]]]


def claims(t):
    return verify.extract_claims(t["figs"], t["audit"], t["holding"], t["rating"], t["tone"], t["restated"])


CLAIMS = """claims AS (
SELECT a.applicant_id, 'revenue' AS claim_id, CASE WHEN revenue > 0 THEN 'Revenue from operations: ' || format('{:,.1f}', revenue) || ' Cr'
  ELSE 'Revenue figure not extracted from annual report' END AS claim_text, CASE WHEN revenue > 0 THEN revenue ELSE 0.0 END AS num_value,
  CAST(NULL AS DOUBLE) AS second_value, CAST(NULL AS BOOLEAN) AS clean, CAST(NULL AS VARCHAR) AS rating,
  CAST(NULL AS VARCHAR) AS label, CASE WHEN revenue > 0 THEN 'HIGH' ELSE 'LOW' END AS confidence
  FROM audit a LEFT JOIN figs USING (applicant_id)
UNION ALL SELECT applicant_id, 'profitability', 'Reported profitability: ' || concat_ws(', ',
  'EBITDA ' || format('{:,.1f}', nullif(ebitda, 0)) || ' Cr', 'PAT ' || format('{:,.1f}', nullif(pat, 0)) || ' Cr'), nullif(ebitda, 0), nullif(pat, 0), NULL, NULL, NULL,
  CASE WHEN nullif(ebitda, 0) IS NOT NULL AND nullif(pat, 0) IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END FROM figs
  WHERE nullif(ebitda, 0) IS NOT NULL OR nullif(pat, 0) IS NOT NULL
UNION ALL SELECT applicant_id, 'no_statutory_defaults', CASE WHEN caro_default_found OR adverse_opinion_found
  THEN 'CARO defaults / auditor qualification detected' ELSE 'No statutory defaults or auditor qualifications detected' END, NULL, NULL, NOT (caro_default_found OR adverse_opinion_found), NULL, NULL, 'HIGH' FROM audit
UNION ALL SELECT applicant_id, 'going_concern', CASE WHEN emphasis_of_matter_found THEN 'Going concern / emphasis of matter flagged by auditor'
  ELSE 'No going concern issues raised by auditor' END, NULL, NULL, NOT emphasis_of_matter_found, NULL, NULL, 'HIGH' FROM audit
UNION ALL SELECT applicant_id, 'promoter_stability', printf('Promoter holding at %.1f%%, pledged %.1f%%',
  coalesce(promoter_holding_pct, 0), coalesce(pledged_pct, 0)), coalesce(promoter_holding_pct, 0), coalesce(pledged_pct, 0), NULL, NULL, NULL,
  CASE WHEN promoter_holding_pct > 0 THEN 'HIGH' ELSE 'LOW' END FROM holding
UNION ALL SELECT applicant_id, 'credit_rating', 'Rated ' || latest_rating || ' by ' || latest_agency ||
  CASE WHEN is_investment_grade THEN ', investment grade' ELSE ', sub-investment grade' END ||
  CASE WHEN downgrade_detected THEN ' (DOWNGRADE DETECTED)' ELSE '' END, NULL, NULL, NULL, latest_rating, NULL, 'HIGH' FROM rating WHERE latest_rating IS NOT NULL
UNION ALL SELECT applicant_id, 'litigation_status', CASE WHEN caro_default_found THEN 'Auditor report flags statutory issues'
  ELSE 'Auditor report does not flag material litigation' END, NULL, NULL, NOT caro_default_found, NULL, NULL, 'MEDIUM' FROM audit
UNION ALL SELECT applicant_id, 'management_outlook', printf('Management outlook %s (sentiment score: %+.3f)',
  CASE WHEN sentiment_score > 0.02 THEN 'positive' WHEN sentiment_score < -0.02 THEN 'negative' ELSE 'neutral' END, sentiment_score),
  sentiment_score, NULL, NULL, NULL, CASE WHEN sentiment_score > 0.02 THEN 'positive'
  WHEN sentiment_score < -0.02 THEN 'negative' ELSE 'neutral' END, 'MEDIUM' FROM tone WHERE status = 'success'
UNION ALL SELECT applicant_id, 'financial_consistency', CASE WHEN restatements_detected THEN 'Prior year figures restated'
  ELSE 'No prior year restatements' END || CASE WHEN auditor_changed THEN '; auditor changed' ELSE '' END, NULL, NULL, NOT restatements_detected, NULL, NULL,
  CASE WHEN restatements_detected THEN 'MEDIUM' ELSE 'HIGH' END FROM restated)"""


@query("claims", f"{BASE}, {CLAIMS} SELECT * FROM claims")
def all_claims(spark, sf_dir):
    return claims(tables(spark, sf_dir))


GRADES = "('AAA', 'AA+', 'AA', 'AA-', 'A+', 'A', 'A-', 'BBB+', 'BBB', 'BBB-')"
BAD = "CASE WHEN clean THEN '{}' ELSE '{}' END"


def check_sql(source: str, icon: str, claim: str, join: str, cases: list[tuple[str, ...]], keep: str = "true") -> str:
    """Cases: condition, status, severity, finding, detail; text that starts with an SQL word or call is an expression."""
    lit = lambda v: v if v.startswith(("CASE ", "printf(", "concat(")) else "'" + v.replace("'", "''") + "'"
    pick = lambda n: "CASE " + " ".join(f"WHEN {c[0]} THEN {lit(c[n])}" for c in cases) + " END"
    return (f"SELECT applicant_id, claim_id, claim_text, '{source}' AS source, '{icon}' AS source_icon, {pick(1)} AS status, {pick(2)} AS severity, "
            f"{pick(3)} AS finding, {pick(4)} AS detail FROM (SELECT * FROM claims WHERE claim_id = '{claim}') {join} WHERE {keep}")


CREDITS, RATIO = "total_credits / 1e7", "(total_credits / 1e7 / num_value)"
SHARE = f"printf('Bank deposits: %s Cr (%.0f%% of claimed revenue)', format('{{:,.1f}}', {CREDITS}), {RATIO} * 100)"
SUITS = "list_slice(['Section 138 complaint', 'Recovery suit'], 1, suits)"
SQL_CHECKS = {
    "revenue_checks": check_sql("Bank Statement", "bank", "revenue", "LEFT JOIN statement USING (applicant_id)", [
        ("coalesce(total_credits, 0) <= 0", "UNVERIFIABLE", "LOW", "No bank statement provided",
         "Upload a bank statement CSV to verify revenue against actual deposits."),
        ("num_value <= 0", "UNVERIFIABLE", "LOW", f"concat('Bank deposits: ', format('{{:,.1f}}', {CREDITS}), ' Cr')",
         "Revenue not extracted from annual report; cannot compare."),
        (f"{RATIO} >= 0.9", "MATCH", "INFO", SHARE, "Bank credits are consistent with reported revenue."),
        (f"{RATIO} >= 0.7", "PARTIAL_MATCH", "MEDIUM", SHARE,
         f"printf('Bank credits are %.0f%% below claimed revenue. Some gap is normal (multi-bank, inter-company) but warrants review.', (1 - {RATIO}) * 100)"),
        ("true", "MISMATCH", "HIGH", SHARE.replace("(%.0f", "(only %.0f"),
         f"printf('Bank credits %s Cr below claimed revenue — a %.0f%% shortfall suggesting revenue inflation or collections routed through "
         f"undisclosed accounts.', format('{{:,.1f}}', num_value - {CREDITS}), (1 - {RATIO}) * 100)")]),
    "gst_checks": check_sql("Perfios / GST", "gst", "revenue", "LEFT JOIN gst USING (applicant_id)", [
        ("mismatch_pct IS NULL", "UNVERIFIABLE", "LOW", "GST reconciliation data not available", "Perfios GST data not available for verification."),
        ("mismatch_pct > 15", "MISMATCH", "HIGH", "concat('GST 2A vs 3B mismatch: ', mismatch_pct, '%')",
         "concat('GSTR-2A/3B gap of ', mismatch_pct, '% indicates invoices claimed as input tax credit may not have corresponding supplier filings. "
         "Suggests potential ghost invoicing or inflated purchases.')"),
        ("mismatch_pct > 5", "PARTIAL_MATCH", "MEDIUM", "concat('GST 2A vs 3B mismatch: ', mismatch_pct, '%')",
         "concat('Moderate GST mismatch of ', mismatch_pct, '%. Some gap is normal (timing differences) but above comfortable threshold.')"),
        ("true", "MATCH", "INFO", "concat('GST 2A vs 3B mismatch: ', mismatch_pct, '% (within limits)')", "GST filings are consistent with supplier data.")]),
    "profit_checks": check_sql("Sector Benchmark", "benchmark", "profitability", "LEFT JOIN bench USING (applicant_id)", [
        ("sector IS NULL", "UNVERIFIABLE", "LOW", "Sector benchmark not available", "No sector benchmark data to compare profitability against."),
        ("deviation_pct IS NULL", "UNVERIFIABLE", "LOW", "EBITDA benchmark data not available",
         "Sector comparison could not be performed for profitability."),
        ("deviation_pct < -25", "MISMATCH", "HIGH", "printf('EBITDA margin %.0f%% below sector benchmark', abs(deviation_pct))",
         "Significant underperformance vs sector peers raises questions about reported profitability."),
        ("deviation_pct < -10", "PARTIAL_MATCH", "MEDIUM", "printf('EBITDA margin %.0f%% below sector average', abs(deviation_pct))",
         "Moderate underperformance vs sector — not alarming but notable."),
        ("true", "MATCH", "INFO", "EBITDA margin in line with sector benchmark", "Reported profitability is consistent with industry performance.")]),
    "default_checks": check_sql("CIBIL Bureau", "cibil", "no_statutory_defaults", "LEFT JOIN bureau USING (applicant_id)", [
        ("dpd_30 IS NULL", "UNVERIFIABLE", "LOW", "CIBIL data not available", "Credit bureau data not available for verification."),
        ("dpd_90 > 0 OR suit_filed_cr > 0", BAD.format("MISMATCH", "MATCH"), BAD.format("HIGH", "INFO"),
         "concat('CIBIL: ', dpd_30, ' DPD-30, ', dpd_90, ' DPD-90, suit filed ', suit_filed_cr, ' Cr')",
         BAD.format("Bureau data shows payment defaults and/or suit filed — contradicts clean compliance claim in annual report.",
                    "Bureau data confirms compliance issues flagged in auditor report.")),
        ("dpd_30 > 0", BAD.format("PARTIAL_MATCH", "MATCH"), BAD.format("MEDIUM", "INFO"),
         "concat('CIBIL: ', dpd_30, ' instances of 30-day past due')",
         BAD.format("Minor payment delays detected in bureau data. Not severe but inconsistent with clean compliance narrative.",
                    "Bureau data shows minor delays, consistent with auditor flags.")),
        ("true", "MATCH", "INFO", "CIBIL: No DPD or suits filed", "Bureau data confirms clean payment history."),
    ]) + " UNION ALL " + check_sql("Karza Registry", "karza", "no_statutory_defaults", "LEFT JOIN registry USING (applicant_id)", [
        ("epfo_compliance IS NULL", "UNVERIFIABLE", "LOW", "Karza data not available", "Karza registry data not available."),
        ("director_disqualified OR epfo_compliance NOT IN ('Regular', 'Unknown')", BAD.format("MISMATCH", "MATCH"), BAD.format("HIGH", "INFO"),
         "concat('Karza: ', concat_ws(', ', CASE WHEN director_disqualified THEN 'director disqualified' END, "
         "CASE WHEN epfo_compliance NOT IN ('Regular', 'Unknown') THEN 'EPFO: ' || epfo_compliance END))",
         BAD.format("Registry data shows compliance issues not disclosed in annual report.", "Consistent with auditor findings.")),
        ("true", "MATCH", "INFO", "concat('Karza: EPFO ', epfo_compliance, ', no director disqualification')",
         "Company registry confirms clean compliance status.")]),
    "concern_checks": check_sql(
        "News / Media", "news", "going_concern", "LEFT JOIN news USING (applicant_id) LEFT JOIN concern USING (applicant_id)", [
            ("adverse_media_detected IS NULL", "UNVERIFIABLE", "LOW", "News data not available", "News scan not performed."),
            ("adverse_media_detected AND coalesce(ending, false)", BAD.format("MISMATCH", "MATCH"), BAD.format("HIGH", "MEDIUM"),
             "printf('Adverse media: %d red flag article(s) with going-concern signals', coalesce(red_flags, 0))",
             BAD.format("News reports mention insolvency/NCLT proceedings — contradicts going concern assumption.",
                        "Media confirms concerns already flagged by auditor.")),
            ("adverse_media_detected", BAD.format("PARTIAL_MATCH", "MATCH"), "MEDIUM",
             "printf('Adverse media detected (%d articles) but no going-concern keywords', coalesce(red_flags, 0))",
             "Negative press found but not specifically about business continuity."),
            ("true", "MATCH", "INFO", "No adverse media detected", "Media scan found no negative reports about the company."),
        ]) + " UNION ALL " + check_sql("CIBIL Score", "cibil", "going_concern", "LEFT JOIN bureau USING (applicant_id)", [
            ("credit_score < 40", BAD.format("MISMATCH", "MATCH"), "HIGH", "concat('CIBIL score: ', credit_score, '/100 (distressed)')",
             "Very low credit score signals severe financial stress — going concern risk."),
            ("credit_score < 60", "PARTIAL_MATCH", "MEDIUM", "concat('CIBIL score: ', credit_score, '/100 (below average)')",
             "Below-average credit score suggests financial strain."),
            ("true", "MATCH", "INFO", "concat('CIBIL score: ', credit_score, '/100 (adequate)')",
             "Credit score does not indicate going concern risk.")], "credit_score IS NOT NULL"),
    "rating_checks": check_sql("CIBIL Rating", "cibil", "credit_rating", "LEFT JOIN bureau USING (applicant_id)", [
        ("credit_score IS NULL", "UNVERIFIABLE", "LOW", "Bureau data not available", "CIBIL data not available for rating verification."),
        ("bureau_rating = ''", "UNVERIFIABLE", "LOW", "Rating comparison not possible",
         "Either AR or bureau rating not available for comparison."),
        ("rating = upper(replace(bureau_rating, ' ', ''))", "MATCH", "INFO", "concat('Bureau rating ', bureau_rating, ' matches AR disclosure')",
         "Credit rating confirmed by independent bureau."),
        (f"(rating IN {GRADES}) <> (upper(replace(bureau_rating, ' ', '')) IN {GRADES})", "MISMATCH", "HIGH",
         "concat('Bureau rating ', bureau_rating, ' vs AR disclosed ', rating, ' — grade tier mismatch')",
         "Annual report claims investment grade but bureau shows sub-investment, or vice versa. Significant discrepancy."),
        ("true", "PARTIAL_MATCH", "MEDIUM", "concat('Bureau rating ', bureau_rating, ' vs AR disclosed ', rating)",
         "Ratings differ but within same tier. May reflect timing or agency differences.")]),
    "litigation_checks": check_sql("eCourts", "ecourts", "litigation_status", "LEFT JOIN courts USING (applicant_id)", [
        ("cases_found IS NULL", "UNVERIFIABLE", "LOW", "Court data not available", "eCourts scan not performed."),
        ("high_risk_cases > 0 AND clean", "MISMATCH", "HIGH",
         "printf('eCourts: %d high-risk case(s) out of %d total', high_risk_cases, cases_found)",
         "Court records show material litigation not adequately disclosed in annual report."),
        ("cases_found > 0 AND clean", "PARTIAL_MATCH", "MEDIUM", "printf('eCourts: %d case(s) found, %d high-risk', cases_found, high_risk_cases)",
         "Some court proceedings found — annual report may understate litigation exposure."),
        ("cases_found > 0", "MATCH", "INFO", "printf('eCourts: %d case(s) found', cases_found)",
         "Court cases consistent with disclosures in auditor report."),
        ("true", "MATCH", "INFO", "eCourts: No cases found", "Court records confirm clean litigation status."),
    ]) + " UNION ALL " + check_sql("Karza Litigation", "karza", "litigation_status", "LEFT JOIN registry USING (applicant_id)", [
        ("suits > 0 AND clean", "PARTIAL_MATCH", "MEDIUM", "printf('Karza: %d active litigation(s)', suits)",
         f"concat('Registry shows: ', array_to_string({SUITS}, '; '), '. Annual report does not flag these.')"),
        ("suits > 0", "MATCH", "INFO", "printf('Karza: %d active litigation(s)', suits)", "Consistent with auditor disclosures."),
        ("true", "MATCH", "INFO", "Karza: No active litigations", "Registry confirms clean litigation status.")], "epfo_compliance IS NOT NULL"),
    "promoter_checks": check_sql("Shareholding Pattern", "shareholding", "promoter_stability", "", [
        ("num_value <= 0", "UNVERIFIABLE", "LOW", "Shareholding data not extracted", "Could not extract shareholding details from annual report."),
        ("second_value > 50", "MISMATCH", "HIGH", "printf('Promoter pledge: %.1f%% of holding', second_value)",
         "Over half of promoter shares are pledged — signals financial stress and potential forced liquidation risk."),
        ("second_value > 20", "PARTIAL_MATCH", "MEDIUM", "printf('Promoter pledge: %.1f%% of holding', second_value)",
         "Significant share pledge warrants monitoring."),
        ("true", "MATCH", "INFO", "printf('Promoter pledge: %.1f%% — within acceptable limits', second_value)", "Promoter shareholding appears stable."),
    ]) + " UNION ALL " + check_sql("Shareholding Pattern", "shareholding", "promoter_stability", "", [
        ("true", "PARTIAL_MATCH", "MEDIUM", "printf('Low promoter holding: %.1f%%', num_value)",
         "Promoter holding below 26% raises control and commitment concerns.")], "num_value > 0 AND num_value < 26"),
    "outlook_checks": check_sql("Site Visit", "site_visit", "management_outlook", "LEFT JOIN site USING (applicant_id)", [
        ("coalesce(site_findings, 0) = 0", "UNVERIFIABLE", "LOW", "No site visit data available", "Site visit not conducted or no notes provided."),
        ("label = 'positive'", "MISMATCH", "MEDIUM", "printf('Site visit: %d adverse finding(s) vs positive MD&A tone', site_findings)",
         "Management projects optimism in MD&A but site visit reveals operational issues — narrative may be misleading."),
        ("true", "MATCH", "INFO", "printf('Site visit: %d finding(s), consistent with cautious MD&A tone', site_findings)",
         "Site visit findings align with management's measured outlook.")]),
    "reconciliation_checks": """SELECT applicant_id, 'gst_bank_reconciliation' AS claim_id,
  'Reconciliation of GST turnover with bank credits' AS claim_text, 'Reconciliation Engine' AS source, 'gst' AS source_icon,
  CASE WHEN missing THEN 'UNVERIFIABLE' WHEN abs(off) > 20 THEN 'MISMATCH' WHEN abs(off) > 10 THEN 'PARTIAL_MATCH' ELSE 'MATCH' END AS status,
  CASE WHEN missing THEN 'LOW' WHEN abs(off) > 20 THEN 'HIGH' WHEN abs(off) > 10 THEN 'MEDIUM' ELSE 'INFO' END AS severity,
  CASE WHEN no_gst AND no_bank THEN 'GST and Bank data missing' WHEN no_gst THEN 'GST data unavailable'
    WHEN no_bank THEN 'Bank statement not uploaded' WHEN missing THEN 'GST turnover not found'
    ELSE printf('GST Turnover: ₹%s Cr | Bank Credits: ₹%s Cr | Variance: %+.0f%%', told, paid, off) END AS finding,
  CASE WHEN no_gst AND no_bank THEN 'Upload a bank statement and ensure GST data is available to run reconciliation.'
    WHEN no_gst THEN 'GST/Perfios data is required alongside the bank statement to run reconciliation.'
    WHEN no_bank THEN 'Upload a bank statement CSV to reconcile GST turnover against actual bank credits.'
    WHEN missing THEN 'Cannot perform reconciliation without GST turnover data.'
    ELSE array_to_string(['GST Turnover FY23: ₹' || told || ' Cr', 'Bank Credits FY23: ₹' || paid || ' Cr', '', printf('Variance: %+.0f%%', off), '',
      'Observations:', '• ' || CASE WHEN abs(off) > 15 THEN 'High' WHEN abs(off) > 8 THEN 'Moderate' ELSE 'Low' END
      || ' mismatch between GST and bank flows', printf('• %.0f%% invoices unmatched in bank statements', least(100, greatest(0, abs(off) * 0.8 + 4))),
      '• ' || CASE WHEN coalesce(cash_spikes, 0) > 0 THEN 'High' ELSE 'Normal' END || ' cash component in deposits', '', 'Conclusion:',
      CASE WHEN off < -15 THEN 'Reported turnover may be overstated.' ELSE 'GST and Bank flows are reconcilable.' END,
      CASE WHEN abs(off) > 10 THEN 'Credit exposure should be conservatively assessed.' ELSE 'Standard credit assessment recommended.' END],
      chr(10)) END AS detail
FROM (SELECT *, no_gst OR no_bank OR coalesce(turnover_cr, 0) <= 0 AS missing, format('{:,.1f}', turnover_cr) AS told, format('{:,.1f}', credits) AS paid
  FROM (SELECT a.applicant_id, mismatch_pct IS NULL AS no_gst, coalesce(total_transactions, 0) <= 0 AS no_bank, turnover_cr, cash_spikes,
    coalesce(total_credits, 0) / 1e7 AS credits, (coalesce(total_credits, 0) / 1e7 - turnover_cr) / nullif(turnover_cr, 0) * 100 AS off
    FROM audit a LEFT JOIN gst USING (applicant_id) LEFT JOIN statement USING (applicant_id)))""",
}
CONCERN = """concern AS (SELECT applicant_id, count(*) AS red_flags, bool_or(regexp_matches(lower(headline || summary),
  'winding up|nclt|insolvency|bankruptcy|closure')) AS ending FROM articles GROUP BY applicant_id)"""
CHECKED = f"{BASE}, {CLAIMS}, {CONCERN}"
ALL_CHECKS = " UNION ALL ".join(SQL_CHECKS.values())

SPARK_CHECKS = {
    "revenue_checks": lambda c, t: verify.check_revenue(c, t["statement"]),
    "gst_checks": lambda c, t: verify.check_gst(c, t["gst"]),
    "profit_checks": lambda c, t: verify.check_profit(c, t["bench"]),
    "default_checks": lambda c, t: verify.check_defaults(c, t["bureau"], t["registry"]),
    "concern_checks": lambda c, t: verify.check_concern(c, t["news"], t["red_flags"], t["bureau"]),
    "rating_checks": lambda c, t: verify.check_rating(c, t["bureau"]),
    "litigation_checks": lambda c, t: verify.check_litigation(c, t["courts"], t["registry"]),
    "promoter_checks": lambda c, t: verify.check_promoter(c),
    "outlook_checks": lambda c, t: verify.check_outlook(c, t["site"]),
    "reconciliation_checks": lambda c, t: verify.reconcile_gst_bank(t["audit"], t["gst"], t["statement"]),
}


def _register(name, build):
    @query(name, f"{CHECKED} {SQL_CHECKS[name]}")
    def run(spark, sf_dir):
        t = tables(spark, sf_dir)
        return build(claims(t), t)


for _name, _build in SPARK_CHECKS.items():
    _register(_name, _build)

RANKED = f"""{CHECKED}, checks AS ({ALL_CHECKS}),
rolled AS (SELECT applicant_id, claim_id, count(*) AS checks,
  ['MISMATCH', 'PARTIAL_MATCH', 'MATCH', 'UNVERIFIABLE'][min(list_position(['MISMATCH', 'PARTIAL_MATCH', 'MATCH', 'UNVERIFIABLE'], status))]
    AS overall_status,
  ['HIGH', 'MEDIUM', 'LOW', 'INFO'][min(list_position(['HIGH', 'MEDIUM', 'LOW', 'INFO'], severity))] AS overall_severity
  FROM checks GROUP BY 1, 2)"""


def rolled(spark, sf_dir):
    t = tables(spark, sf_dir)
    return verify.roll_up(verify.verify(claims(t), t))


@query("claim_verdicts", f"{RANKED} SELECT * FROM rolled")
def claim_verdicts(spark, sf_dir):
    return rolled(spark, sf_dir).drop("claim_text")


@query("verdict_summary", f"""{RANKED} SELECT applicant_id, count(*) AS total_claims,
  count(*) FILTER (WHERE overall_status = 'MATCH') AS verified, count(*) FILTER (WHERE overall_status = 'MISMATCH') AS mismatched,
  count(*) FILTER (WHERE overall_status = 'PARTIAL_MATCH') AS partial,
  count(*) FILTER (WHERE overall_status = 'UNVERIFIABLE') AS unverifiable FROM rolled GROUP BY applicant_id""")
def verdict_summary(spark, sf_dir):
    return verify.verdict_summary(rolled(spark, sf_dir))


@query("verification_rules", f"""{RANKED} SELECT applicant_id, concat_ws(',',
  CASE WHEN bool_or(claim_id = 'revenue' AND overall_status = 'MISMATCH') THEN 'P-31' END,
  CASE WHEN bool_or(claim_id IN ('no_statutory_defaults', 'litigation_status', 'credit_rating', 'going_concern')
    AND overall_status = 'MISMATCH') THEN 'P-32' END,
  CASE WHEN bool_or(claim_id = 'gst_bank_reconciliation' AND overall_status = 'MISMATCH') THEN 'P-33' END) AS triggered_rules
FROM rolled GROUP BY applicant_id""")
def verification_rules(spark, sf_dir):
    return verify.verification_rules(rolled(spark, sf_dir)).withColumn("triggered_rules", F.array_join("triggered_rules", ","))


@query("contradicted_claims", f"""{RANKED} SELECT applicant_id, claim_id, overall_severity FROM rolled
WHERE overall_status = 'MISMATCH' AND claim_id <> 'gst_bank_reconciliation'""")
def contradicted_claims(spark, sf_dir):
    return verify.contradicted(rolled(spark, sf_dir)).select("applicant_id", "claim_id", "overall_severity")


@query("reconciliation_memo", f"""{BASE}, j AS (SELECT applicant_id, turnover_cr,
  CASE WHEN coalesce(total_credits, 0) > 100 THEN total_credits / 1e7 ELSE coalesce(total_credits, 0) END AS credits_cr
  FROM gst LEFT JOIN statement USING (applicant_id)),
v AS (SELECT *, CASE WHEN turnover_cr > 0 AND credits_cr > 0 THEN (credits_cr - turnover_cr) / turnover_cr * 100 END AS off FROM j)
SELECT applicant_id, turnover_cr, credits_cr, round(off, 4) + 0.0 AS variance_pct, CASE WHEN abs(off) > 20 THEN 'MISMATCH — HIGH VARIANCE'
  WHEN abs(off) > 10 THEN 'PARTIAL MATCH — MODERATE VARIANCE' WHEN off IS NOT NULL THEN 'MATCH — RECONCILED'
  WHEN turnover_cr > 0 THEN 'UNVERIFIABLE — Bank statement required' ELSE 'GST data not available for reconciliation.' END
  AS reconciliation_status FROM v""")
def reconciliation_memo(spark, sf_dir):
    t = tables(spark, sf_dir)
    return memo.reconciliation_memo(t["gst"], t["statement"]).drop("observation")
