"""Claims of the report against bank, tax, bureau, registry, court, news and site evidence.

``claims``: applicant_id, claim_id, claim_text and the values a check may need. Evidence
tables hold one row per applicant, so each check is one left join on applicant_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.session import settle

CLAIM_COLUMNS = {
    "applicant_id": "bigint", "claim_id": "string", "claim_text": "string", "num_value": "double",
    "second_value": "double", "clean": "boolean", "rating": "string", "label": "string", "confidence": "string",
}
MATCH, PARTIAL, MISMATCH, UNVERIFIABLE = "MATCH", "PARTIAL_MATCH", "MISMATCH", "UNVERIFIABLE"
HIGH, MEDIUM, LOW, INFO = "HIGH", "MEDIUM", "LOW", "INFO"


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# --- Claims --------------------------------------------------------------------------
def _claim(frame: DataFrame, claim_id: str, text: Column, confidence: Column | str, **values: Column) -> DataFrame:
    have = {"claim_id": F.lit(claim_id), "claim_text": text, "confidence": _column(confidence), **values}
    return frame.select(*[
        F.col("applicant_id") if name == "applicant_id"
        else have[name].cast(kind).alias(name) if name in have else F.lit(None).cast(kind).alias(name)
        for name, kind in CLAIM_COLUMNS.items()])


def extract_claims(
    figures: DataFrame, audit: DataFrame, holding: DataFrame, rating: DataFrame, tone: DataFrame, restated: DataFrame,
) -> DataFrame:
    """What the report asserts, one row per applicant and claim.

    ``figures``: applicant_id, revenue, ebitda, pat of the current year; ``audit``: the
    three flags, for every applicant; the others only where the report covers them.
    """
    scanned = audit.join(figures, "applicant_id", "left")
    positive = F.coalesce(F.col("revenue") > 0, F.lit(False))
    revenue = _claim(
        scanned, "revenue", F.when(positive, F.format_string("Revenue from operations: %,.1f Cr", "revenue"))
        .otherwise("Revenue figure not extracted from annual report"), F.when(positive, HIGH).otherwise(LOW),
        num_value=F.when(positive, F.col("revenue")).otherwise(0.0))
    ebitda, pat = F.nullif("ebitda", F.lit(0.0)), F.nullif("pat", F.lit(0.0))
    profit = _claim(
        figures.filter(ebitda.isNotNull() | pat.isNotNull()), "profitability",
        F.concat(F.lit("Reported profitability: "), F.concat_ws(
            ", ", F.when(ebitda.isNotNull(), F.format_string("EBITDA %,.1f Cr", "ebitda")),
            F.when(pat.isNotNull(), F.format_string("PAT %,.1f Cr", "pat")))),
        F.when(ebitda.isNotNull() & pat.isNotNull(), HIGH).otherwise(MEDIUM), num_value=ebitda, second_value=pat)
    failing = F.col("caro_default_found") | F.col("adverse_opinion_found")
    defaults = _claim(
        audit, "no_statutory_defaults", F.when(failing, "CARO defaults / auditor qualification detected")
        .otherwise("No statutory defaults or auditor qualifications detected"), HIGH, clean=~failing)
    emphasis = F.col("emphasis_of_matter_found")
    concern = _claim(
        audit, "going_concern", F.when(emphasis, "Going concern / emphasis of matter flagged by auditor")
        .otherwise("No going concern issues raised by auditor"), HIGH, clean=~emphasis)
    held, pledged = (F.coalesce(c, F.lit(0.0)) for c in ("promoter_holding_pct", "pledged_pct"))
    promoter = _claim(
        holding, "promoter_stability", F.format_string("Promoter holding at %.1f%%, pledged %.1f%%", held, pledged),
        F.when(held > 0, HIGH).otherwise(LOW), num_value=held, second_value=pledged)
    graded = _claim(
        rating.filter("latest_rating IS NOT NULL"), "credit_rating", F.concat(
            F.lit("Rated "), "latest_rating", F.lit(" by "), F.coalesce("latest_agency", F.lit("rating agency")),
            F.when(F.col("is_investment_grade"), ", investment grade").otherwise(", sub-investment grade"),
            F.when(F.col("downgrade_detected"), " (DOWNGRADE DETECTED)").otherwise("")),
        HIGH, rating=F.col("latest_rating"))
    caro = F.col("caro_default_found")
    litigation = _claim(
        audit, "litigation_status", F.when(caro, "Auditor report flags statutory issues")
        .otherwise("Auditor report does not flag material litigation"), MEDIUM, clean=~caro)
    score = F.col("sentiment_score")
    mood = F.when(score > 0.02, "positive").when(score < -0.02, "negative").otherwise("neutral")
    outlook = _claim(
        tone.filter("status = 'success'"), "management_outlook",
        F.format_string("Management outlook %s (sentiment score: %+.3f)", mood, score), MEDIUM, num_value=score, label=mood)
    changed = F.col("restatements_detected")
    consistent = _claim(
        restated, "financial_consistency", F.concat(
            F.when(changed, "Prior year figures restated").otherwise("No prior year restatements"),
            F.when(F.col("auditor_changed"), "; auditor changed").otherwise("")),
        F.when(changed, MEDIUM).otherwise(HIGH), clean=~changed)
    return reduce(DataFrame.unionByName, [
        revenue, profit, defaults, concern, promoter, graded, litigation, outlook, consistent])


# --- Checks --------------------------------------------------------------------------
def _outcome(*cases: tuple) -> list[tuple]:
    """Cases of a check: condition, status, severity, finding and detail. The first that holds decides; without one there is no row."""
    return [tuple(map(_column, case)) for case in cases]


RECONCILIATION = "gst_bank_reconciliation"
#: What the checks read of each evidence table, besides applicant_id.
EVIDENCE = {
    "statement": ("total_credits", "total_transactions", "cash_spikes"), "gst": ("mismatch_pct", "turnover_cr"),
    "benchmark": ("sector", "deviation_pct"), "bureau": ("dpd_30", "dpd_90", "suit_filed_cr", "credit_score", "bureau_rating"),
    "registry": ("director_disqualified", "epfo_compliance", "active_litigations"), "news": ("adverse_media_detected",),
    "concern": ("red_flags", "concern"), "courts": ("cases_found", "high_risk_cases"), "site": ("site_findings",),
}
#: A check: the claim it looks at, its source and icon, and its cases over a claim and its evidence.
Check = tuple[str, str, str, list[tuple]]


def _run(claims: DataFrame, checks: list[Check], **evidence: DataFrame) -> DataFrame:
    """Rows of all checks, from claims that meet each evidence table once.

    A claim is exploded into the numbers of the cases that hold, and each column is read by that
    number, so that a reader of the status alone has no finding or detail written.
    """
    both = claims.filter(F.col("claim_id").isin(sorted({claim_id for claim_id, *_ in checks})))
    # Evidence tables meet per applicant, of which there are fewer than claims. They are settled by threes:
    # a longer chain of joins holds the sorted rows of all its tables in one task.
    seen = both if len(evidence) < 3 else both.select("applicant_id").distinct()
    for place, (name, frame) in enumerate(evidence.items(), 1):
        seen = seen.join(frame.select("applicant_id", *[c for c in EVIDENCE[name] if c in frame.columns]), "applicant_id", "left")
        if place % 3 == 0:
            seen = settle(seen)
    both = seen if len(evidence) < 3 else both.join(seen, "applicant_id", "left")
    cases, holding = [], {}
    for claim_id, source, icon, outcome in checks:
        which = None
        for condition, *row in outcome:
            number = F.lit(len(cases))
            which = F.when(condition, number) if which is None else which.when(condition, number)
            cases.append((F.lit(source), F.lit(icon), *row))
        holding.setdefault(claim_id, []).append(which)
    numbers = None
    for claim_id, which in holding.items():
        number = F.array_compact(F.array(*which))
        numbers = (F.when if numbers is None else numbers.when)(F.col("claim_id") == claim_id, number)
    # Within explode the numbers would be interpreted; as a column they are compiled.
    rows = both.withColumn("_cases", numbers).withColumn("_case", F.explode("_cases"))
    columns = []
    for place, name in enumerate(("source", "source_icon", "status", "severity", "finding", "detail")):
        read = None
        for number, row in enumerate(cases):
            read = (F.when if read is None else read.when)(F.col("_case") == number, row[place])
        columns.append(read.alias(name))
    return rows.select("applicant_id", "claim_id", "claim_text", *columns)


def revenue_checks() -> list[Check]:
    """Bank credits as a share of claimed revenue."""
    credits, revenue = F.col("total_credits") / fv.RUPEES_PER_CRORE, F.col("num_value")
    ratio = credits / F.nullif(revenue, F.lit(0.0))
    share = F.format_string("Bank deposits: %,.1f Cr (%.0f%% of claimed revenue)", credits, ratio * 100)
    return [("revenue", "Bank Statement", "bank", _outcome(
        (F.coalesce(F.col("total_credits") <= 0, F.lit(True)), UNVERIFIABLE, LOW, "No bank statement provided",
         "Upload a bank statement CSV to verify revenue against actual deposits."),
        (revenue <= 0, UNVERIFIABLE, LOW, F.format_string("Bank deposits: %,.1f Cr", credits),
         "Revenue not extracted from annual report; cannot compare."),
        (ratio >= 0.90, MATCH, INFO, share, "Bank credits are consistent with reported revenue."),
        (ratio >= 0.70, PARTIAL, MEDIUM, share, F.format_string(
            "Bank credits are %.0f%% below claimed revenue. Some gap is normal (multi-bank, inter-company) but "
            "warrants review.", (1 - ratio) * 100)),
        (F.lit(True), MISMATCH, HIGH,
         F.format_string("Bank deposits: %,.1f Cr (only %.0f%% of claimed revenue)", credits, ratio * 100),
         F.format_string(
             "Bank credits %,.1f Cr below claimed revenue — a %.0f%% shortfall suggesting revenue inflation or "
             "collections routed through undisclosed accounts.", revenue - credits, (1 - ratio) * 100)),
    ))]


def gst_checks() -> list[Check]:
    """Gap between the two tax returns."""
    gap = F.col("mismatch_pct")
    found = F.concat(F.lit("GST 2A vs 3B mismatch: "), gap.cast("string"), F.lit("%"))
    return [("revenue", "Perfios / GST", "gst", _outcome(
        (gap.isNull(), UNVERIFIABLE, LOW, "GST reconciliation data not available",
         "Perfios GST data not available for verification."),
        (gap > 15, MISMATCH, HIGH, found, F.concat(
            F.lit("GSTR-2A/3B gap of "), gap.cast("string"),
            F.lit("% indicates invoices claimed as input tax credit may not have corresponding supplier filings. "
                  "Suggests potential ghost invoicing or inflated purchases."))),
        (gap > 5, PARTIAL, MEDIUM, found, F.concat(
            F.lit("Moderate GST mismatch of "), gap.cast("string"),
            F.lit("%. Some gap is normal (timing differences) but above comfortable threshold."))),
        (F.lit(True), MATCH, INFO, F.concat(found, F.lit(" (within limits)")),
         "GST filings are consistent with supplier data."),
    ))]


def profit_checks() -> list[Check]:
    """EBITDA margin against the sector (``deviation_pct``; ``sector`` null if none ran)."""
    off = F.col("deviation_pct")
    return [("profitability", "Sector Benchmark", "benchmark", _outcome(
        (F.col("sector").isNull(), UNVERIFIABLE, LOW, "Sector benchmark not available",
         "No sector benchmark data to compare profitability against."),
        (off.isNull(), UNVERIFIABLE, LOW, "EBITDA benchmark data not available",
         "Sector comparison could not be performed for profitability."),
        (off < -25, MISMATCH, HIGH, F.format_string("EBITDA margin %.0f%% below sector benchmark", F.abs(off)),
         "Significant underperformance vs sector peers raises questions about reported profitability."),
        (off < -10, PARTIAL, MEDIUM, F.format_string("EBITDA margin %.0f%% below sector average", F.abs(off)),
         "Moderate underperformance vs sector — not alarming but notable."),
        (F.lit(True), MATCH, INFO, "EBITDA margin in line with sector benchmark",
         "Reported profitability is consistent with industry performance."),
    ))]


def default_checks() -> list[Check]:
    """Payment record and registry compliance; findings invert if the report admits them."""
    clean = F.coalesce("clean", F.lit(True))
    turn = lambda bad, good: F.when(clean, bad).otherwise(good)
    d30, d90, suit = F.col("dpd_30"), F.col("dpd_90"), F.col("suit_filed_cr")
    paid = ("no_statutory_defaults", "CIBIL Bureau", "cibil", _outcome(
        (d30.isNull(), UNVERIFIABLE, LOW, "CIBIL data not available",
         "Credit bureau data not available for verification."),
        ((d90 > 0) | (suit > 0), turn(MISMATCH, MATCH), turn(HIGH, INFO), F.concat(
            F.lit("CIBIL: "), d30.cast("string"), F.lit(" DPD-30, "), d90.cast("string"), F.lit(" DPD-90, suit filed "),
            suit.cast("string"), F.lit(" Cr")),
         turn("Bureau data shows payment defaults and/or suit filed — contradicts clean compliance claim in annual "
              "report.", "Bureau data confirms compliance issues flagged in auditor report.")),
        (d30 > 0, turn(PARTIAL, MATCH), turn(MEDIUM, INFO),
         F.concat(F.lit("CIBIL: "), d30.cast("string"), F.lit(" instances of 30-day past due")),
         turn("Minor payment delays detected in bureau data. Not severe but inconsistent with clean compliance "
              "narrative.", "Bureau data shows minor delays, consistent with auditor flags.")),
        (F.lit(True), MATCH, INFO, "CIBIL: No DPD or suits filed", "Bureau data confirms clean payment history."),
    ))
    epfo = F.col("epfo_compliance")
    issues = F.concat_ws(
        ", ", F.when(F.col("director_disqualified"), "director disqualified"),
        F.when(~epfo.isin("Regular", "Unknown"), F.concat(F.lit("EPFO: "), epfo)))
    listed = ("no_statutory_defaults", "Karza Registry", "karza", _outcome(
        (epfo.isNull(), UNVERIFIABLE, LOW, "Karza data not available", "Karza registry data not available."),
        (F.length(issues) > 0, turn(MISMATCH, MATCH), turn(HIGH, INFO), F.concat(F.lit("Karza: "), issues),
         turn("Registry data shows compliance issues not disclosed in annual report.",
              "Consistent with auditor findings.")),
        (F.lit(True), MATCH, INFO, F.concat(F.lit("Karza: EPFO "), epfo, F.lit(", no director disqualification")),
         "Company registry confirms clean compliance status."),
    ))
    return [paid, listed]


def concern_flags(red_flags: DataFrame) -> DataFrame:
    """Red-flag articles per applicant and whether any speaks of the business ending."""
    text = F.lower(F.concat(F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit(""))))
    return red_flags.groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("red_flags"), F.bool_or(text.rlike("|".join(fv.CONCERN_WORDS))).alias("concern"))


def concern_checks() -> list[Check]:
    """Media signals of closure and the bureau score."""
    clean = F.coalesce("clean", F.lit(True))
    turn = lambda bad, good: F.when(clean, bad).otherwise(good)
    n = F.coalesce("red_flags", F.lit(0))
    told = ("going_concern", "News / Media", "news", _outcome(
        (F.col("adverse_media_detected").isNull(), UNVERIFIABLE, LOW, "News data not available",
         "News scan not performed."),
        (F.col("adverse_media_detected") & F.coalesce("concern", F.lit(False)), turn(MISMATCH, MATCH),
         turn(HIGH, MEDIUM), F.format_string("Adverse media: %d red flag article(s) with going-concern signals", n),
         turn("News reports mention insolvency/NCLT proceedings — contradicts going concern assumption.",
              "Media confirms concerns already flagged by auditor.")),
        (F.col("adverse_media_detected"), turn(PARTIAL, MATCH), MEDIUM,
         F.format_string("Adverse media detected (%d articles) but no going-concern keywords", n),
         "Negative press found but not specifically about business continuity."),
        (F.lit(True), MATCH, INFO, "No adverse media detected",
         "Media scan found no negative reports about the company."),
    ))
    score = F.col("credit_score")
    shown = lambda word: F.concat(F.lit("CIBIL score: "), score.cast("string"), F.lit(f"/100 ({word})"))
    scored = ("going_concern", "CIBIL Score", "cibil", _outcome(
        (score < 40, turn(MISMATCH, MATCH), HIGH, shown("distressed"),
         "Very low credit score signals severe financial stress — going concern risk."),
        (score < 60, PARTIAL, MEDIUM, shown("below average"), "Below-average credit score suggests financial strain."),
        (score.isNotNull(), MATCH, INFO, shown("adequate"), "Credit score does not indicate going concern risk."),
    ))
    return [told, scored]


def rating_checks() -> list[Check]:
    """Disclosed rating against the bureau's: equal, same tier or other tier."""
    plain = lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))
    own, theirs = plain(F.col("rating")), plain(F.col("bureau_rating"))
    blank = (F.coalesce(F.length("rating"), F.lit(0)) == 0) | (F.coalesce(F.length("bureau_rating"), F.lit(0)) == 0)
    both = F.concat(F.lit("Bureau rating "), "bureau_rating", F.lit(" vs AR disclosed "), "rating")
    return [("credit_rating", "CIBIL Rating", "cibil", _outcome(
        (F.col("credit_score").isNull(), UNVERIFIABLE, LOW, "Bureau data not available",
         "CIBIL data not available for rating verification."),
        (blank, UNVERIFIABLE, LOW, "Rating comparison not possible",
         "Either AR or bureau rating not available for comparison."),
        (own == theirs, MATCH, INFO, F.concat(F.lit("Bureau rating "), "bureau_rating", F.lit(" matches AR disclosure")),
         "Credit rating confirmed by independent bureau."),
        (own.isin(*fv.INVESTMENT_GRADES) != theirs.isin(*fv.INVESTMENT_GRADES), MISMATCH, HIGH,
         F.concat(both, F.lit(" — grade tier mismatch")),
         "Annual report claims investment grade but bureau shows sub-investment, or vice versa. Significant "
         "discrepancy."),
        (F.lit(True), PARTIAL, MEDIUM, both,
         "Ratings differ but within same tier. May reflect timing or agency differences."),
    ))]


def litigation_checks() -> list[Check]:
    """Court cases and registry proceedings against the report's silence."""
    clean = F.coalesce("clean", F.lit(True))
    cases, risky = F.col("cases_found"), F.col("high_risk_cases")
    in_court = ("litigation_status", "eCourts", "ecourts", _outcome(
        (cases.isNull(), UNVERIFIABLE, LOW, "Court data not available", "eCourts scan not performed."),
        ((risky > 0) & clean, MISMATCH, HIGH,
         F.format_string("eCourts: %d high-risk case(s) out of %d total", risky, cases),
         "Court records show material litigation not adequately disclosed in annual report."),
        ((cases > 0) & clean, PARTIAL, MEDIUM, F.format_string("eCourts: %d case(s) found, %d high-risk", cases, risky),
         "Some court proceedings found — annual report may understate litigation exposure."),
        (cases > 0, MATCH, INFO, F.format_string("eCourts: %d case(s) found", cases),
         "Court cases consistent with disclosures in auditor report."),
        (F.lit(True), MATCH, INFO, "eCourts: No cases found", "Court records confirm clean litigation status."),
    ))
    suits, known = F.col("active_litigations"), F.col("epfo_compliance").isNotNull()
    found = F.format_string("Karza: %d active litigation(s)", F.size(suits))
    registered = ("litigation_status", "Karza Litigation", "karza", _outcome(
        (known & (F.size(suits) > 0) & clean, PARTIAL, MEDIUM, found, F.concat(
            F.lit("Registry shows: "), F.array_join(F.slice(suits, 1, 3), "; "),
            F.lit(". Annual report does not flag these."))),
        (known & (F.size(suits) > 0), MATCH, INFO, found, "Consistent with auditor disclosures."),
        (known, MATCH, INFO, "Karza: No active litigations", "Registry confirms clean litigation status."),
    ))
    return [in_court, registered]


def promoter_checks() -> list[Check]:
    """Pledge and level of the promoter holding."""
    held, pledged = F.col("num_value"), F.col("second_value")
    shown = F.format_string("Promoter pledge: %.1f%% of holding", pledged)
    pledge = ("promoter_stability", "Shareholding Pattern", "shareholding", _outcome(
        (held <= 0, UNVERIFIABLE, LOW, "Shareholding data not extracted",
         "Could not extract shareholding details from annual report."),
        (pledged > 50, MISMATCH, HIGH, shown,
         "Over half of promoter shares are pledged — signals financial stress and potential forced liquidation risk."),
        (pledged > 20, PARTIAL, MEDIUM, shown, "Significant share pledge warrants monitoring."),
        (F.lit(True), MATCH, INFO,
         F.format_string("Promoter pledge: %.1f%% — within acceptable limits", pledged),
         "Promoter shareholding appears stable."),
    ))
    level = ("promoter_stability", "Shareholding Pattern", "shareholding", _outcome(
        ((held > 0) & (held < 26), PARTIAL, MEDIUM, F.format_string("Low promoter holding: %.1f%%", held),
         "Promoter holding below 26% raises control and commitment concerns."),
    ))
    return [pledge, level]


def outlook_checks() -> list[Check]:
    """Tone of the discussion against the number of adverse site findings."""
    n = F.col("site_findings")
    return [("management_outlook", "Site Visit", "site_visit", _outcome(
        (F.coalesce(n, F.lit(0)) == 0, UNVERIFIABLE, LOW, "No site visit data available",
         "Site visit not conducted or no notes provided."),
        (F.col("label") == "positive", MISMATCH, MEDIUM,
         F.format_string("Site visit: %d adverse finding(s) vs positive MD&A tone", n),
         "Management projects optimism in MD&A but site visit reveals operational issues — narrative may be "
         "misleading."),
        (F.lit(True), MATCH, INFO, F.format_string("Site visit: %d finding(s), consistent with cautious MD&A tone", n),
         "Site visit findings align with management's measured outlook."),
    ))]


def reconciliation_checks() -> list[Check]:
    """Tax turnover against bank credits, with the missing-data cases."""
    turnover, credits = F.col("turnover_cr"), F.coalesce("total_credits", F.lit(0.0)) / fv.RUPEES_PER_CRORE
    has_gst, has_bank = F.col("mismatch_pct").isNotNull(), F.coalesce("total_transactions", F.lit(0)) > 0
    off = (credits - turnover) / F.nullif(turnover, F.lit(0.0)) * 100
    unmatched = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.abs(off) * 0.8 + 4))
    finding = F.format_string(
        "GST Turnover: ₹%,.1f Cr | Bank Credits: ₹%,.1f Cr | Variance: %+.0f%%", turnover, credits, off)
    detail = lambda matched: F.format_string(
        "GST Turnover FY23: ₹%,.1f Cr\nBank Credits FY23: ₹%,.1f Cr\n\nVariance: %+.0f%%\n\nObservations:\n"
        "• %s mismatch between GST and bank flows\n• %.0f%% invoices unmatched in bank statements\n"
        "• %s cash component in deposits\n\nConclusion:\n%s\n%s",
        turnover, credits, off, F.when(F.abs(off) > 15, "High").when(F.abs(off) > 8, "Moderate").otherwise("Low"),
        unmatched, F.when(F.coalesce("cash_spikes", F.lit(0)) > 0, "High").otherwise("Normal"),
        F.when(off < -15, "Reported turnover may be overstated.").otherwise("GST and Bank flows are reconcilable."),
        F.lit("Standard credit assessment recommended." if matched
              else "Credit exposure should be conservatively assessed."))
    return [(RECONCILIATION, "Reconciliation Engine", "gst", _outcome(
        (~has_gst & ~has_bank, UNVERIFIABLE, LOW, "GST and Bank data missing",
         "Upload a bank statement and ensure GST data is available to run reconciliation."),
        (~has_gst, UNVERIFIABLE, LOW, "GST data unavailable",
         "GST/Perfios data is required alongside the bank statement to run reconciliation."),
        (~has_bank, UNVERIFIABLE, LOW, "Bank statement not uploaded",
         "Upload a bank statement CSV to reconcile GST turnover against actual bank credits."),
        (F.coalesce(turnover, F.lit(0.0)) <= 0, UNVERIFIABLE, LOW, "GST turnover not found",
         "Cannot perform reconciliation without GST turnover data."),
        (F.abs(off) > 20, MISMATCH, HIGH, finding, detail(False)),
        (F.abs(off) > 10, PARTIAL, MEDIUM, finding, detail(False)),
        (F.lit(True), MATCH, INFO, finding, detail(True)),
    ))]


def reconciled(applicants: DataFrame) -> DataFrame:
    """The reconciliation as a claim of every applicant."""
    return applicants.select("applicant_id").distinct().select(
        "applicant_id", F.lit(RECONCILIATION).alias("claim_id"), F.lit("Reconciliation of GST turnover with bank credits").alias("claim_text"))


def check_revenue(claims: DataFrame, statement: DataFrame) -> DataFrame:
    return _run(claims, revenue_checks(), statement=statement)


def check_gst(claims: DataFrame, gst: DataFrame) -> DataFrame:
    return _run(claims, gst_checks(), gst=gst)


def check_profit(claims: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _run(claims, profit_checks(), benchmark=benchmark)


def check_defaults(claims: DataFrame, bureau: DataFrame, registry: DataFrame) -> DataFrame:
    return _run(claims, default_checks(), bureau=bureau, registry=registry)


def check_concern(claims: DataFrame, news: DataFrame, red_flags: DataFrame, bureau: DataFrame) -> DataFrame:
    return _run(claims, concern_checks(), news=news, concern=concern_flags(red_flags), bureau=bureau)


def check_rating(claims: DataFrame, bureau: DataFrame) -> DataFrame:
    return _run(claims, rating_checks(), bureau=bureau)


def check_litigation(claims: DataFrame, courts: DataFrame, registry: DataFrame) -> DataFrame:
    return _run(claims, litigation_checks(), courts=courts, registry=registry)


def check_promoter(claims: DataFrame) -> DataFrame:
    return _run(claims, promoter_checks())


def check_outlook(claims: DataFrame, site: DataFrame) -> DataFrame:
    return _run(claims, outlook_checks(), site=site)


def reconcile_gst_bank(applicants: DataFrame, gst: DataFrame, statement: DataFrame) -> DataFrame:
    """Tax turnover against bank credits, for every applicant."""
    return _run(reconciled(applicants), reconciliation_checks(), gst=gst, statement=statement)


def verify(claims: DataFrame, evidence: dict[str, DataFrame], applicants: DataFrame | None = None) -> DataFrame:
    """All checks of all claims as rows; claims are read once and meet each evidence table once.

    GST and bank turnover are reconciled for every row of ``applicants`` (applicant_id), those
    without a claim among them; without that list for the applicants with claims.
    """
    every = claims.unionByName(reconciled(claims if applicants is None else applicants), allowMissingColumns=True)
    checks = [
        *revenue_checks(), *gst_checks(), *profit_checks(), *default_checks(), *concern_checks(), *rating_checks(), *litigation_checks(),
        *promoter_checks(), *outlook_checks(), *reconciliation_checks()]
    seen = {**evidence, "concern": concern_flags(evidence["red_flags"])}
    return _run(every, checks, **{name: seen[name] for name in EVIDENCE})


# --- Roll-up -------------------------------------------------------------------------
def roll_up(checks: DataFrame) -> DataFrame:
    """Worst status and worst severity per claim."""
    rank = lambda column, order: F.array_position(F.array(*map(F.lit, order)), F.col(column))
    back = lambda column, order: F.element_at(F.array(*map(F.lit, order)), F.col(column).cast("int"))
    return checks.groupBy("applicant_id", "claim_id").agg(
        F.first("claim_text").alias("claim_text"), F.count(F.lit(1)).alias("checks"),
        F.min(rank("status", fv.STATUS_ORDER)).alias("_status"),
        F.min(rank("severity", fv.SEVERITY_ORDER)).alias("_severity"),
    ).select(
        "applicant_id", "claim_id", "claim_text", "checks", back("_status", fv.STATUS_ORDER).alias("overall_status"),
        back("_severity", fv.SEVERITY_ORDER).alias("overall_severity"))


def verdict_summary(verifications: DataFrame) -> DataFrame:
    count = lambda status: F.count_if(F.col("overall_status") == status)
    return verifications.groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("total_claims"), count(MATCH).alias("verified"), count(MISMATCH).alias("mismatched"),
        count(PARTIAL).alias("partial"), count(UNVERIFIABLE).alias("unverifiable"))


def verification_rules(verifications: DataFrame) -> DataFrame:
    """Rules the mismatched claims raise, in fixed order."""
    missed = lambda *claims: F.bool_or(F.col("claim_id").isin(*claims) & (F.col("overall_status") == MISMATCH))
    return verifications.groupBy("applicant_id").agg(
        missed("revenue").alias("r"),
        missed("no_statutory_defaults", "litigation_status", "credit_rating", "going_concern").alias("c"),
        missed("gst_bank_reconciliation").alias("g"),
    ).select("applicant_id", F.array_compact(F.array(
        F.when(F.col("r"), "P-31"), F.when(F.col("c"), "P-32"), F.when(F.col("g"), "P-33"))).alias("triggered_rules"))


def contradicted(verifications: DataFrame) -> DataFrame:
    """Claims the memo lists as contradicted: mismatches other than the reconciliation."""
    return verifications.filter(
        (F.col("overall_status") == MISMATCH) & (F.col("claim_id") != "gst_bank_reconciliation"))
