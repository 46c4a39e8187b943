"""The whole appraisal over a portfolio: every signal, the triggers, the priced result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions.party import with_party
from lendgrain.operators import bank, decision, filings, financials, layout, prose, verify
from lendgrain.session import sent_if_few, settle

# Sources in the order in which they report their rules.
SOURCE_ORDER = [
    "gst", "audit", "restatement", "news", "site", "bank", "benchmark", "registry", "counterparty", "courts",
    "shareholding", "tone", "rating", "collateral", "verification", "purpose",
]


def latest_filings(documents: DataFrame) -> DataFrame:
    """Newest filing per applicant. Only keys are aggregated; the text is picked by its id.

    The choice is settled: each signal reads the chosen texts, and none of its patterns is drawn
    below the choice by a filter on it. Few ids, by count, are broadcast, so that no text is shuffled.
    """
    newest = documents.groupBy("applicant_id").agg(F.max(F.struct("fiscal_year", "doc_id")).alias("k"))
    ids = settle(newest.select(F.col("k.doc_id").alias("doc_id")))
    return settle(documents.join(sent_if_few(ids), "doc_id", "left_semi"))


def section_of(scans: DataFrame, sectioned: DataFrame, section: str) -> DataFrame:
    """Filings with the text of one section in place of their own; empty where they lack it."""
    found = sectioned.filter(F.col("section") == section).select("doc_id", "text")
    return scans.drop("text").join(found, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def audit_texts(scans: DataFrame, sectioned: DataFrame | None) -> DataFrame:
    """Cleaned text the compliance scan reads: audit report and annexure if sections are known, else all of it."""
    if sectioned is None:
        return layout.clean_text(scans)
    report, annexure = (layout.clean_text(section_of(scans, sectioned, name)) for name in ("auditors_report", "auditors_annexure"))
    return filings.with_annexure(report, annexure)


def rules_of(source: str, frame: DataFrame, column: str = "triggered_rules") -> DataFrame:
    """Trigger rows of a source that lists rules, ordered behind the sources before it."""
    return decision.listed_triggers(frame, column, source, 100 * (SOURCE_ORDER.index(source) + 1))


def found_rules(source: str, findings: DataFrame) -> DataFrame:
    """Trigger rows of a source whose findings name one rule each."""
    return findings.select("applicant_id", "rule_id").distinct().select(
        "applicant_id", "rule_id", F.lit(source).alias("source"),
        (F.lit(100 * (SOURCE_ORDER.index(source) + 1)) + F.substring("rule_id", 3, 2).cast("int")).alias("source_ord"))


def recorded(evidence: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rule lists of the registry (disqualified director) and the courts (high-risk cases)."""
    listed = lambda name, rule, when: evidence[name].select(
        "applicant_id", F.array_compact(F.array(F.when(when, rule))).alias("triggered_rules"))
    return {
        "registry": listed("registry", "P-14", F.col("director_disqualified")),
        "courts": listed("courts", "P-15", F.col("high_risk_cases") > 0)}


def appraise(
    txns: DataFrame, documents: DataFrame, notes: DataFrame, evidence: dict[str, DataFrame], figures: DataFrame,
    auditors: DataFrame, rules: DataFrame, lexicon: dict[str, list[str]] | None = None,
    outside: dict[str, DataFrame] | None = None, sectioned: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All signal tables, the triggers and the decision.

    ``txns``: statement rows; ``documents``: applicant_id, doc_id, fiscal_year, text;
    ``notes``: applicant_id, note_id, notes; ``evidence``: tables of ``verify.verify``;
    ``outside``: rule lists (applicant_id, triggered_rules) of sources in ``SOURCE_ORDER`` that
    read none of these, as benchmark (P-30), counterparty (P-06) and purpose (P-34). Registry
    and court rules come from the evidence. The compliance scan reads cleaned text.
    ``sectioned``: doc_id, section, text of ``layout.section_texts``; with it the compliance scan reads
    the audit report and its annexure only, and the tone is that of the management discussion.
    Signals read by several later steps hold one row per filing or applicant; they are
    settled, so texts and statements are read once per signal.
    """
    moves = with_party(txns)
    scans = latest_filings(documents)
    audit, holding = settle(filings.compliance_flags(audit_texts(scans, sectioned))), settle(filings.shareholding(scans))
    rating, tone = settle(filings.rating_status(scans)), settle(prose.lexicon_sentiment(
        scans if sectioned is None else section_of(scans, sectioned, "mda_report"), lexicon))
    pledged = settle(filings.collateral(scans))
    restated = settle(financials.restatement_flags(figures, auditors))
    site = settle(prose.site_visit_signals(notes))
    statement = bank.statement_summary(txns)
    banked = settle(bank.statement_findings(moves))
    counted = banked.filter("rule_id = 'P-29'").select("applicant_id", F.col("found").alias("cash_spikes"))
    read = settle(filings.extract_figures(scans).groupBy("applicant_id").agg(
        F.max(F.when(F.col("figure") == "Revenue", F.col("value"))).alias("revenue"),
        F.max(F.when(F.col("figure") == "EBITDA", F.col("value"))).alias("ebitda"),
        F.max(F.when(F.col("figure") == "PAT", F.col("value"))).alias("pat")))
    seen = {
        **evidence, "statement": settle(statement.join(counted, "applicant_id", "left")),
        "site": site.groupBy("applicant_id").agg(F.count(F.lit(1)).alias("site_findings"))}
    claims = settle(verify.extract_claims(read, audit, holding, rating, tone, restated))
    applicants = settle(reduce(DataFrame.union, [f.select("applicant_id") for f in (txns, scans, notes)]).distinct())
    checks = settle(verify.verify(claims, seen, applicants))
    verdicts = verify.roll_up(checks)
    triggers = decision.union_triggers(
        decision.derive_triggers(gst=evidence["gst"], audit=audit, restated=restated, news=evidence["news"]),
        found_rules("site", site), found_rules("bank", banked),
        rules_of("shareholding", holding), rules_of("tone", tone), rules_of("rating", rating),
        rules_of("collateral", pledged), rules_of("verification", verify.verification_rules(verdicts)),
        *[rules_of(source, frame) for source, frame in recorded(evidence).items()],
        *[rules_of(source, frame) for source, frame in (outside or {}).items()])
    return {
        "applicants": applicants, "audit": audit, "holding": holding, "rating": rating, "tone": tone,
        "collateral": pledged, "restated": restated, "site": site, "statement": statement, "claims": claims,
        "checks": checks, "verdicts": verdicts, "triggers": triggers,
        "decisions": decision.decide(triggers, rules, applicants),
    }


def nested(frame: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows of a child table as one array per applicant, in the given order.

    For child tables with few rows per applicant: penalties, checks, capped findings.
    """
    fields = order + [c for c in frame.columns if c not in ("applicant_id", *order)]
    return frame.groupBy("applicant_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def assemble_result(decisions: DataFrame, scalars: dict[str, DataFrame], children: dict[str, tuple]) -> DataFrame:
    """One nested row per applicant.

    ``scalars``: one-row-per-applicant tables that become structs; ``children``: name ->
    (table, order columns), which become arrays.
    """
    out = decisions
    for name, frame in scalars.items():
        packed = frame.select("applicant_id", F.struct(
            *[c for c in frame.columns if c != "applicant_id"]).alias(name))
        out = out.join(packed, "applicant_id", "left")
    for name, (frame, order) in children.items():
        out = out.join(nested(frame, name, order), "applicant_id", "left")
    return out


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Decision sink: nested parquet, or one JSON document per applicant and line."""
    getattr(results.write.mode(mode), fmt)(path)
