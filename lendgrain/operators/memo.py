"""Credit memo data: sections as rows of (applicant_id, section, line, item, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv

# Memo sections in order.
SECTIONS = [
    "BORROWER PROFILE", "PROPOSAL SUMMARY & RECOMMENDATION", "FINANCIAL ANALYSIS", "GST-BANK RECONCILIATION",
    "COUNTERPARTY INTELLIGENCE & CIRCULAR TRADING", "SUPPLY CHAIN & COMPETITOR ANALYSIS", "VERIFICATION DETAILS",
    "COLLATERAL & SECURITY", "SITE VISIT / FIELD VERIFICATION", "RISK RULE MATRIX & PENALTIES",
    "RECOMMENDATION & CONDITIONS PRECEDENT", "COMMITTEE DECISION",
]


def section_rows(frame: DataFrame, section: int, items: list[tuple[str, Column]], first_line: int = 1) -> DataFrame:
    """The items of one section, one row each; an item with a null value is left out."""
    pairs = F.array(*[
        F.struct(F.lit(first_line + n).alias("line"), F.lit(item).alias("item"), value.cast("string").alias("value"))
        for n, (item, value) in enumerate(items)])
    return frame.select("applicant_id", F.lit(section).alias("section"), F.inline(pairs)).filter("value IS NOT NULL")


def crore(value: Column) -> Column:
    return F.coalesce(F.format_string("₹%.2f Cr", value), F.lit("Not extracted")) if value is not None else None


def _known(value: Column, shown: Column, otherwise: str) -> Column:
    return F.when(value.isNotNull(), shown).otherwise(otherwise)


def profile_rows(registry: DataFrame) -> DataFrame:
    """``registry``: applicant_id, name, cin, incorporated (date), address, activity, status, paid_up_capital."""
    return section_rows(registry, 1, [
        ("Name of Borrower", F.col("name")), ("CIN / LLPIN", F.coalesce("cin", F.lit("Not found in document"))),
        ("Constitution", F.lit("Private Limited Company")),
        ("Date of Incorporation", F.coalesce(F.date_format("incorporated", "dd MMMM yyyy"), F.lit("N/A"))),
        ("Registered Office", F.coalesce("address", F.lit("As per MCA records"))),
        ("Principal Business", F.coalesce("activity", F.lit("As per Annual Report"))),
        ("Company Status (MCA)", F.coalesce("status", F.lit("Active"))),
        ("Paid-up Capital", F.when(F.col("paid_up_capital") > 0, F.format_string(
            "₹%,.2f Cr", F.col("paid_up_capital") / fv.RUPEES_PER_CRORE)).otherwise("N/A")),
        ("Data Verification Source", F.lit("MCA21 / data.gov.in")),
    ])


def proposal_rows(decisions: DataFrame) -> DataFrame:
    return section_rows(decisions, 2, [
        ("Nature of Facility", F.lit("Working Capital / Term Loan")),
        ("Recommended Limit", F.format_string("₹%.2f Crore", "final_limit_cr")),
        ("Recommended Rate", F.format_string("%.2f%% p.a.", "final_rate_pct")),
        ("Base Rate Applied", F.lit(f"{fv.BASE_RATE_PCT:.2f}% p.a.")),
        ("Base Limit Applied", F.lit(f"₹{fv.BASE_LIMIT_CR:.2f} Crore")),
        ("Risk Penalties Applied", F.format_string("%d rules | %d bps total", "penalties_applied", "total_bps")),
        ("FINAL RECOMMENDATION", F.replace("recommendation", F.lit("_"), F.lit(" "))),
    ])


def financial_rows(ratios: DataFrame, restated: DataFrame) -> DataFrame:
    """``ratios``: one scan per applicant, with ``pat`` if known."""
    joined = ratios.join(restated.select("applicant_id", "restatements_detected"), "applicant_id", "left")
    pat = F.col("pat") if "pat" in ratios.columns else F.lit(None).cast("double")
    return section_rows(joined, 3, [
        ("Total Revenue", crore(F.col("revenue"))), ("EBITDA", crore(F.col("ebitda"))),
        ("Profit After Tax (PAT)", crore(pat)), ("Tangible Net Worth", crore(F.col("net_worth"))),
        ("Total Outside Liabilities", crore(F.col("debt"))),
        ("Debt / Equity Ratio", _known(F.col("debt_equity"), F.format_string("%.2fx", "debt_equity"), "N/A")),
        ("EBITDA Margin", _known(F.col("ebitda_margin_pct"), F.format_string("%.1f%%", "ebitda_margin_pct"), "N/A")),
        ("Financial Restatements", F.when(
            F.coalesce("restatements_detected", F.lit(False)), "DETECTED — Silent Restatement [RESTATE-01]"
        ).otherwise("None detected")),
    ])


def banking_rows(summary: DataFrame) -> DataFrame:
    return section_rows(summary.filter("total_transactions > 0"), 3, [
        ("Transactions Analyzed", F.col("total_transactions")),
        ("Total Credits", F.format_string("₹%,.0f", "total_credits")),
        ("Total Debits", F.format_string("₹%,.0f", "total_debits")),
        ("Average Monthly Balance", F.format_string("₹%,.0f", "avg_balance")),
    ], first_line=20)


def reconciliation_memo(gst: DataFrame, statement: DataFrame) -> DataFrame:
    """Tax turnover against bank credits as the memo states it.

    Credits of 100 or less are read as crore already, larger ones as rupees.
    """
    credits = F.coalesce("total_credits", F.lit(0.0))
    joined = gst.join(statement, "applicant_id", "left").withColumn(
        "credits_cr", F.when(credits > 100, credits / fv.RUPEES_PER_CRORE).otherwise(credits))
    turnover, banked = F.coalesce("turnover_cr", F.lit(0.0)), F.col("credits_cr")
    comparable = (turnover > 0) & (banked > 0)
    off = F.when(comparable, (banked - turnover) / F.nullif(turnover, F.lit(0.0)) * 100)
    size = F.abs("variance_pct")
    return joined.withColumn("variance_pct", off).select(
        "applicant_id", turnover.alias("turnover_cr"), "credits_cr", F.round("variance_pct", 4).alias("variance_pct"),
        F.when(size > 20, "MISMATCH — HIGH VARIANCE").when(size > 10, "PARTIAL MATCH — MODERATE VARIANCE")
        .when(size.isNotNull(), "MATCH — RECONCILED").when(turnover > 0, "UNVERIFIABLE — Bank statement required")
        .otherwise("GST data not available for reconciliation.").alias("reconciliation_status"),
        F.when(size > 20, F.format_string(
            "FINDING: A %.0f%% variance between GST-reported turnover and bank credits indicates potential revenue "
            "overstatement or diversion of funds. Credit exposure must be conservatively assessed against verified "
            "bank credits only.", size))
        .when(size > 10, F.format_string(
            "OBSERVATION: %.0f%% variance within monitoring threshold. May reflect timing differences in working "
            "capital cycle. Recommend quarterly reconciliation.", size))
        .when(size.isNotNull(), F.format_string(
            "GST turnover reconciles with bank credits within %.0f%% tolerance. No material discrepancy observed.",
            size)).alias("observation"))


def reconciliation_rows(memo: DataFrame) -> DataFrame:
    return section_rows(memo, 4, [
        ("GST Turnover (Perfios)", F.format_string("₹%.2f Crore", "turnover_cr")),
        ("Bank Statement Credits", F.format_string("₹%.2f Crore", "credits_cr")),
        ("Variance", F.when(F.col("variance_pct").isNotNull(), F.format_string("%+.1f%%", "variance_pct"))),
        ("RECONCILIATION STATUS", F.col("reconciliation_status")), ("Observation", F.col("observation")),
    ])


def counterparty_rows(summary: DataFrame) -> DataFrame:
    return section_rows(summary, 5, [
        ("Counterparties Analyzed", F.col("entities")), ("Shell Company Suspects", F.col("shells")),
        ("Circular Trading Detected", F.when(F.col("loop_flags") > 0, "YES").otherwise("NO")),
        ("Round-trip Flow Chains", F.col("loop_flags")), ("Total Risk Flags", F.col("flags")),
    ])


def supply_rows(told: DataFrame) -> DataFrame:
    banded = lambda side: F.concat(
        f"{side}_risk_band", F.lit(" ("), F.col(f"{side}_risk_score").cast("string"), F.lit(")"))
    return section_rows(told, 6, [
        ("Overall Supply Chain Risk", F.concat(
            "overall_supply_chain_risk_band", F.lit(" (Score: "),
            F.col("overall_supply_chain_risk_score").cast("string"), F.lit(")"))),
        ("Upstream Supplier Risk", banded("supplier")), ("Downstream Buyer Risk", banded("buyer")),
        ("Weakest Link", F.col("weakest_link")), ("Major Supplier", F.col("major_supplier")),
        ("Major Buyer", F.col("major_buyer")), ("Key Risk Factors", F.array_join(F.slice("reasons", 1, 5), "; ")),
    ])


def verification_rows(facts: DataFrame, summary: DataFrame) -> DataFrame:
    """``facts``: per applicant, the statutory and legal flags; ``summary``: verdict counts."""
    joined = facts.join(summary, "applicant_id", "left")
    state = lambda flag, bad, good: F.when(F.coalesce(flag, F.lit(False)), bad).otherwise(good)
    return section_rows(joined, 7, [
        ("MCA Verification", state(F.col("registry_found"), "Verified — Active", "Pending")),
        ("Litigation History", F.when(F.size("active_litigations") > 0, F.array_join("active_litigations", "; "))
         .otherwise("No severe litigations")),
        ("eCourts Cases Found", F.coalesce("cases_found", F.lit(0))),
        ("High-Risk Legal Cases", F.when(F.col("high_risk_cases") > 0, F.concat(
            F.col("high_risk_cases").cast("string"), F.lit(" [LEGAL-01]"))).otherwise("0")),
        ("Adverse Media (NewsScanner)", state(F.col("adverse_media_detected"), "DETECTED [MEDIA-01]", "Clear")),
        ("Auditor Continuity", state(F.col("auditor_changed"), "Changed [AUDIT-03]", "Continuous")),
        ("CARO Findings", state(F.col("caro_default_found"), "Default Reported [AUDIT-01]", "Clear")),
        ("Emphasis of Matter", state(F.col("emphasis_of_matter_found"), "Flagged [AUDIT-02]", "Clear")),
        ("Claims Verified", F.coalesce("verified", F.lit(0))), ("Claims Contradicted", F.coalesce("mismatched", F.lit(0))),
        ("Partial Matches", F.coalesce("partial", F.lit(0))), ("Unverifiable", F.coalesce("unverifiable", F.lit(0))),
    ])


def collateral_rows(found: DataFrame, charges: DataFrame) -> DataFrame:
    """``charges``: applicant_id, charge_holders (array)."""
    joined = found.join(charges, "applicant_id", "left")
    finding = lambda n: F.concat(
        F.get("findings", F.lit(n))["security_type"], F.lit(" on "), F.get("findings", F.lit(n))["asset_type"])
    return section_rows(joined, 8, [
        ("Proposed Security", F.lit("As per sanction terms")), ("Security Coverage", F.lit("N/A")),
        ("Registered Charges (MCA)", F.when(F.size("charge_holders") > 0, F.array_join("charge_holders", ", "))
         .otherwise("No charges on record")),
        ("Unsecured Borrowings", F.when(F.col("has_unsecured_loans"), "DETECTED [P-31]").otherwise("None")),
        *[(f"Security {n + 1}", finding(n)) for n in range(3)],
    ])


def site_rows(visits: DataFrame) -> DataFrame:
    """``visits``: applicant_id, capacity_pct (null if not stated)."""
    cap = F.nullif("capacity_pct", F.lit(0))
    return section_rows(visits, 9, [
        ("Visit Conducted", F.lit("Yes")),
        ("Capacity Utilisation", _known(cap, F.concat(cap.cast("string"), F.lit("%")), "Not quantified")),
        ("Capacity Alert", F.when(cap < fv.CAPACITY_THRESHOLD, F.concat(
            F.lit("BELOW THRESHOLD at "), cap.cast("string"), F.lit("% [PRIMARY-01]")))),
    ])


def matrix_rows(matrix: DataFrame) -> DataFrame:
    return matrix.select(
        "applicant_id", F.lit(10).alias("section"), "line", F.col("name").alias("item"),
        F.format_string("+%d bps | -%d%% | %s", "rate_penalty_bps", "limit_reduction_pct", "memo_severity").alias("value"))


def recommendation_rows(decisions: DataFrame, conditions: DataFrame) -> DataFrame:
    final = section_rows(decisions, 11, [
        ("Recommended Facility Limit", F.format_string("₹%.2f Crore", "final_limit_cr")),
        ("Recommended Interest Rate", F.format_string("%.2f%% p.a.", "final_rate_pct")),
        ("Total Penalties Applied", F.format_string("%d rules, %d bps", "penalties_applied", "total_bps")),
        ("Risk Assessment", F.replace("recommendation", F.lit("_"), F.lit(" "))),
    ])
    listed = conditions.select(
        "applicant_id", F.lit(11).alias("section"), (F.col("line") + 20).alias("line"),
        F.lit("Condition Precedent").alias("item"), F.col("condition").alias("value"))
    return final.unionByName(listed)


def committee_rows(applicants: DataFrame) -> DataFrame:
    return section_rows(applicants.select("applicant_id").distinct(), 12, [
        (role, F.lit("Signature pending")) for role in ("Credit Officer", "Branch Manager", "Sanctioning Authority")])


def memo_rows(*parts: DataFrame) -> DataFrame:
    """All sections as one table, with the section title."""
    titles = F.array(*map(F.lit, SECTIONS))
    return reduce(DataFrame.unionByName, parts).withColumn("title", F.element_at(titles, F.col("section")))
