"""From triggered rules to rate, limit and recommendation.

``triggers``: applicant_id, rule_id, source, source_ord (order in which a source reports).
After ``union_triggers`` an applicant has at most one row per rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.session import sent_if_few


def rule_table(spark: SparkSession, rows: list[tuple] = fv.RULES) -> DataFrame:
    return spark.createDataFrame(rows, fv.RULE_SCHEMA)


def flag_triggers(signals: DataFrame, rule_id: str, when: Column, source: str, order: int) -> DataFrame:
    """One trigger row per applicant whose signal satisfies a condition."""
    return signals.filter(when).select(
        "applicant_id", F.lit(rule_id).alias("rule_id"), F.lit(source).alias("source"),
        F.lit(order).alias("source_ord"))


def listed_triggers(signals: DataFrame, rules: str, source: str, order: int) -> DataFrame:
    """Rules a source already reports as an array, in its own order."""
    return signals.select(
        "applicant_id", F.posexplode(rules).alias("pos", "rule_id")
    ).select(
        "applicant_id", "rule_id", F.lit(source).alias("source"), (F.lit(order) + F.col("pos")).alias("source_ord"))


def derive_triggers(
    gst: DataFrame | None = None, audit: DataFrame | None = None, restated: DataFrame | None = None,
    news: DataFrame | None = None, listed: list[tuple[str, DataFrame, str]] = (),
) -> DataFrame:
    """Triggers of the threshold and flag sources, then of the sources that list rules.

    Orders follow the fold: tax, audit report, restatement, media, then each listed source.
    """
    parts = []
    if gst is not None:
        parts.append(flag_triggers(gst, "P-01", F.col("mismatch_pct") > 15, "gst", 100))
    if audit is not None:
        parts.append(flag_triggers(
            audit, "P-03", F.col("caro_default_found") | F.col("adverse_opinion_found"), "audit", 200))
        parts.append(flag_triggers(audit, "P-04", F.col("emphasis_of_matter_found"), "audit", 201))
    if restated is not None:
        parts.append(flag_triggers(restated, "P-09", F.col("restatements_detected"), "restatement", 300))
        parts.append(flag_triggers(restated, "P-10", F.col("auditor_changed"), "restatement", 301))
    if news is not None:
        parts.append(flag_triggers(news, "P-13", F.col("adverse_media_detected"), "news", 400))
    for number, (source, frame, column) in enumerate(listed):
        parts.append(listed_triggers(frame, column, source, 500 + 100 * number))
    return reduce(DataFrame.unionByName, parts)


def union_triggers(*sources: DataFrame) -> DataFrame:
    """Ordered distinct union: each rule once per applicant, at its first appearance."""
    return (
        reduce(DataFrame.unionByName, sources).groupBy("applicant_id", "rule_id")
        .agg(F.min_by("source", "source_ord").alias("source"), F.min("source_ord").alias("source_ord"))
    )


def apply_rules(triggers: DataFrame, rules: DataFrame) -> DataFrame:
    """Penalties of the triggers that have a definition; others carry no price.

    The rule table has one row per rule id; a small one, by count, is broadcast.
    """
    return triggers.join(sent_if_few(rules), "rule_id")


def decide(
    triggers: DataFrame, rules: DataFrame, applicants: DataFrame | None = None,
    base_rate: float = fv.BASE_RATE_PCT, base_limit: float = fv.BASE_LIMIT_CR, sources: list[str] | None = None,
) -> DataFrame:
    """Rate adds up, limit multiplies, any manual rule wins, any trigger conditions.

    ``sources`` prices only triggers of those sources. ``applicants`` adds those
    without triggers.
    """
    if sources is not None:
        triggers = triggers.filter(F.col("source").isin(*sources))
    priced = triggers.join(sent_if_few(rules), "rule_id", "left")
    folded = priced.groupBy("applicant_id").agg(
        F.coalesce(F.sum("rate_penalty_bps"), F.lit(0)).alias("total_bps"),
        F.array_sort(F.collect_list(F.when(F.col("limit_reduction_pct").isNotNull(), F.struct(
            "source_ord", "rule_id", "rate_penalty_bps", "limit_reduction_pct")))).alias("cuts"),
        F.coalesce(F.bool_or("requires_manual_review"), F.lit(False)).alias("requires_manual_review"),
        F.count(F.lit(1)).alias("rules_triggered"),
        F.count("rate_penalty_bps").alias("penalties_applied"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("source_ord", "rule_id"))), lambda t: t["rule_id"]
        ).alias("triggered_rules"),
    )
    if applicants is not None:
        folded = applicants.select("applicant_id").distinct().join(folded, "applicant_id", "left")
    # Penalties apply in trigger order, so both sums are the same doubles on every run.
    rate = F.coalesce(F.aggregate("cuts", F.lit(base_rate), lambda now, c: now + c["rate_penalty_bps"] / 100),
                      F.lit(base_rate))
    limit = F.coalesce(F.aggregate("cuts", F.lit(base_limit), lambda left, c: left * (
        1 - c["limit_reduction_pct"] / 100)), F.lit(base_limit))
    rules_triggered = F.coalesce("rules_triggered", F.lit(0).cast("bigint"))
    manual = F.coalesce("requires_manual_review", F.lit(False))
    return folded.select(
        "applicant_id",
        F.round(rate, 2).alias("final_rate_pct"),
        F.round(limit, 2).alias("final_limit_cr"),
        F.when(manual, "MANUAL_REVIEW").when(rules_triggered > 0, "CONDITIONAL_APPROVAL").otherwise("APPROVE")
        .alias("recommendation"),
        manual.alias("requires_manual_review"),
        rules_triggered.alias("rules_triggered"),
        F.coalesce("penalties_applied", F.lit(0).cast("bigint")).alias("penalties_applied"),
        F.coalesce("total_bps", F.lit(0).cast("bigint")).alias("total_bps"),
        F.coalesce("triggered_rules", F.expr("array()").cast("array<string>")).alias("triggered_rules"),
    )


def waterfall(
    triggers: DataFrame, rules: DataFrame, findings: DataFrame | None = None,
    base_rate: float = fv.BASE_RATE_PCT, base_limit: float = fv.BASE_LIMIT_CR,
) -> DataFrame:
    """One step per priced rule with the running rate and limit after it.

    ``findings`` (applicant_id, rule_id, finding) overrides the trigger text. The
    window is per applicant over at most one row per rule.
    """
    priced = apply_rules(triggers, rules)
    if findings is None:
        priced = priced.withColumn("finding", F.col("trigger"))
    else:
        priced = priced.join(findings, ["applicant_id", "rule_id"], "left").withColumn(
            "finding", F.coalesce("finding", "trigger"))
    order = Window.partitionBy("applicant_id").orderBy("source_ord", "rule_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = priced.select(
        "applicant_id", (F.row_number().over(order) + 1).alias("step"), "rule_id", "name", "finding",
        "rate_penalty_bps", "limit_reduction_pct",
        F.collect_list("rate_penalty_bps").over(so_far).alias("_adds"),
        F.collect_list("limit_reduction_pct").over(so_far).alias("_cuts"),
    ).withColumns({
        "running_rate": F.aggregate("_adds", F.lit(base_rate), lambda now, bps: now + bps / 100),
        "running_limit": F.aggregate("_cuts", F.lit(base_limit), lambda left, cut: left * (1 - cut / 100)),
    }).drop("_adds", "_cuts")
    rate_part = F.when(F.col("rate_penalty_bps") > 0, F.format_string(
        "+%d bps to rate (now %.1f%%)", "rate_penalty_bps", "running_rate"))
    limit_part = F.when(F.col("limit_reduction_pct") > 0, F.format_string(
        "−%d%% limit cut (now ₹%.2f Cr)", "limit_reduction_pct", "running_limit"))
    penalty = F.nullif(F.concat_ws("; ", rate_part, limit_part), F.lit(""))
    return steps.withColumn("description", F.concat(
        "name", F.lit(" — "), "finding", F.lit(" → "), F.coalesce(penalty, F.lit("no auto-penalty")), F.lit(".")))


def restatement_findings(restated: DataFrame, history: DataFrame) -> DataFrame:
    """Finding texts of P-09 (first restatement) and P-10 (auditors seen)."""
    first = restated.groupBy("applicant_id").agg(F.min(F.struct(
        "year_restated", "figure_ord", "figure", "change_pct")).alias("r"))
    p09 = first.select("applicant_id", F.lit("P-09").alias("rule_id"), F.concat(
        "r.figure", F.lit(" restated by "), F.col("r.change_pct").cast("string"), F.lit("% in "), "r.year_restated",
        F.lit(" comparative")).alias("finding"))
    p10 = history.filter("auditor_changed").select("applicant_id", F.lit("P-10").alias("rule_id"), F.concat(
        F.lit("auditor changed across reporting periods (history: "), F.array_join("auditors", ", "), F.lit(")"),
    ).alias("finding"))
    return p09.unionByName(p10)


def audit_findings(audit: DataFrame) -> DataFrame:
    """Finding texts of P-03 and P-04 from the audit report flags."""
    caro = F.when(F.col("caro_default_found"), "CARO 2020 statutory default detected")
    adverse = F.when(F.col("adverse_opinion_found"), "adverse/qualified auditor opinion found")
    p03 = audit.filter("caro_default_found OR adverse_opinion_found").select(
        "applicant_id", F.lit("P-03").alias("rule_id"), F.concat_ws(" and ", caro, adverse).alias("finding"))
    p04 = audit.filter("emphasis_of_matter_found").select(
        "applicant_id", F.lit("P-04").alias("rule_id"),
        F.lit("auditor flagged going concern / material uncertainty in Emphasis of Matter paragraph").alias("finding"))
    return p03.unionByName(p04)


def narrative(
    steps: DataFrame, decisions: DataFrame, base_rate: float = fv.BASE_RATE_PCT, base_limit: float = fv.BASE_LIMIT_CR,
) -> DataFrame:
    """Numbered plain-language account of each decision, baseline to verdict."""
    told = steps.groupBy("applicant_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("step", "description"))),
            lambda s: F.concat(F.lit("Step "), s["step"].cast("string"), F.lit(": "), s["description"])), "\n",
        ).alias("body"),
        F.transform(
            F.slice(F.array_sort(F.collect_list(F.struct("step", "name", "finding"))), 1, 3),
            lambda s: F.concat(s["name"], F.lit(" — "), s["finding"])).alias("leading"),
    )
    base = f"Step 1: Base rate set at {base_rate}% (repo rate + bank spread). Base limit set at ₹{base_limit} Cr."
    verdict = F.format_string(
        "Final Decision: Rate %s%% | Limit ₹%s Cr | %s", F.col("final_rate_pct").cast("string"),
        F.col("final_limit_cr").cast("string"), "recommendation")
    fired = F.col("rules_triggered")
    rationale = F.when(fired == 0, F.lit(
        f"APPROVE — No risk signals detected across all scanners. Base rate {base_rate}% and limit "
        f"₹{base_limit} Cr maintained.")).otherwise(F.format_string(
            "%s — %d rule%s triggered. %s. Final rate: %.2f%%, limit: ₹%.1f Cr.",
            F.replace("recommendation", F.lit("_"), F.lit(" ")), fired,
            F.when(fired > 1, "s").otherwise(""), F.array_join(F.coalesce("leading", F.array()), "; "),
            "final_rate_pct", "final_limit_cr"))
    return decisions.join(told, "applicant_id", "left").select(
        "applicant_id", F.concat_ws("\n", F.lit(base), "body", verdict).alias("narrative"),
        rationale.alias("rationale"))


def penalty_totals(triggers: DataFrame, rules: DataFrame) -> DataFrame:
    """Number of priced rules, basis points and summed limit cuts per applicant."""
    return apply_rules(triggers, rules).groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("penalties"), F.sum("rate_penalty_bps").alias("total_bps"),
        F.sum("limit_reduction_pct").alias("total_cut_pct"))


def risk_matrix(triggers: DataFrame, rules: DataFrame) -> DataFrame:
    """Memo matrix: restatement is critical, a cut above 10 % high, the rest medium."""
    severity = F.when(F.col("rule_id") == "P-09", "CRITICAL").when(
        F.col("limit_reduction_pct") > 10, "HIGH").otherwise("MEDIUM")
    place = Window.partitionBy("applicant_id").orderBy("source_ord", "rule_id")
    return apply_rules(triggers, rules).select(
        "applicant_id", F.row_number().over(place).alias("line"), "rule_id", "name", "trigger", "rate_penalty_bps",
        "limit_reduction_pct", severity.alias("memo_severity"))


def conditions(triggers: DataFrame, applicants: DataFrame) -> DataFrame:
    """Conditions precedent: those of fired rules in memo order, then the standing ones."""
    spark = applicants.sparkSession
    mapped = spark.createDataFrame(
        [(n, r, c) for n, (r, c) in enumerate(fv.RULE_CONDITIONS)], "ord int, rule_id string, condition string")
    fired = triggers.select("applicant_id", "rule_id").distinct().join(F.broadcast(mapped), "rule_id").select(
        "applicant_id", "ord", "condition")
    standing = applicants.select("applicant_id").distinct().select(
        "applicant_id", F.posexplode(F.array(*map(F.lit, fv.STANDING_CONDITIONS))).alias("pos", "condition")
    ).select("applicant_id", (F.col("pos") + len(fv.RULE_CONDITIONS)).alias("ord"), "condition")
    place = Window.partitionBy("applicant_id").orderBy("ord")
    return fired.unionByName(standing).select(
        "applicant_id", F.row_number().over(place).alias("line"), "condition")
