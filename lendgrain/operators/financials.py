"""Multi-year financial figures: restatements, trends, auditors, ratios.

``figures``: applicant_id, fiscal_year, figure, value, previous_value. One row per
figure and year, so an applicant's rows are bounded by its years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Figures compared across years, in report order, and those with a trend.
COMPARED = ["Revenue", "EBITDA", "PAT", "Total Debt", "Net Worth"]
TRENDED = ["Revenue", "PAT", "Net Worth"]


def year_ranks(figures: DataFrame) -> DataFrame:
    """Scans of an applicant numbered in order of their year label."""
    scans = figures.select("applicant_id", "fiscal_year").distinct()
    order = Window.partitionBy("applicant_id").orderBy("fiscal_year")
    return scans.withColumn("scan", F.row_number().over(order))


def restatements(figures: DataFrame, flag_pct: float = 2.0, high_pct: float = 10.0) -> DataFrame:
    """Comparatives of a scan that differ from what the preceding scan reported.

    Scans are adjacent by applicant, not by figure: a figure the preceding scan
    lacks is skipped, not looked up further back.
    """
    ranked = figures.filter(F.col("figure").isin(*COMPARED)).join(
        year_ranks(figures), ["applicant_id", "fiscal_year"])
    # One row per figure and scan, so the preceding scan's row is the one before, if it is adjacent.
    before = Window.partitionBy("applicant_id", "figure").orderBy("scan")
    adjacent = F.lag("scan").over(before) == F.col("scan") - 1
    paired = ranked.withColumns({
        "original_value": F.when(adjacent, F.lag("value").over(before)),
        "year_restated": F.when(adjacent, F.lag("fiscal_year").over(before))})
    change = (F.col("previous_value") - F.col("original_value")) / F.abs("original_value") * 100
    order = F.array_position(F.array(*map(F.lit, COMPARED)), F.col("figure")).cast("int")
    return (
        paired
        .filter("previous_value IS NOT NULL AND original_value IS NOT NULL AND original_value <> 0")
        .withColumn("change", change).filter(F.abs("change") > flag_pct)
        .select(
            "applicant_id", "figure", order.alias("figure_ord"), "year_restated",
            F.col("fiscal_year").alias("restated_in"), "original_value",
            F.col("previous_value").alias("restated_value"), F.round("change", 1).alias("change_pct"),
            F.when(F.abs("change") > high_pct, "HIGH").otherwise("MEDIUM").alias("severity"),
            F.when(F.col("change") < 0, "downward").otherwise("upward").alias("direction"),
        )
    )


def auditor_history(auditors: DataFrame) -> DataFrame:
    """Auditors of an applicant in year order and whether they changed."""
    named = auditors.filter("auditor IS NOT NULL AND auditor <> ''")
    return named.groupBy("applicant_id").agg(
        (F.count_distinct("auditor") > 1).alias("auditor_changed"),
        F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", "auditor"))), lambda a: a["auditor"])
        .alias("auditors"),
        F.max_by("auditor", "fiscal_year").alias("latest_auditor"),
    )


def auditor_changes(auditors: DataFrame) -> DataFrame:
    """Years whose auditor differs from the one before."""
    order = Window.partitionBy("applicant_id").orderBy("fiscal_year")
    return (
        auditors.filter("auditor IS NOT NULL AND auditor <> ''")
        .withColumn("previous_auditor", F.lag("auditor").over(order))
        .filter("previous_auditor IS NOT NULL AND auditor <> previous_auditor")
        .select("applicant_id", "fiscal_year", "previous_auditor", "auditor")
    )


def restatement_flags(figures: DataFrame, auditors: DataFrame) -> DataFrame:
    """Both multi-year flags per applicant."""
    restated = restatements(figures).select("applicant_id", F.lit(True).alias("restated")).distinct()
    changed = auditor_history(auditors).select("applicant_id", "auditor_changed")
    scanned = figures.select("applicant_id").union(auditors.select("applicant_id")).distinct()
    return scanned.join(restated, "applicant_id", "left").join(changed, "applicant_id", "left").select(
        "applicant_id", F.coalesce("restated", F.lit(False)).alias("restatements_detected"),
        F.coalesce("auditor_changed", F.lit(False)).alias("auditor_changed"))


def yoy_trend(figures: DataFrame, band: float = 5.0) -> DataFrame:
    """Change between the two newest scans and its direction, for the trended figures."""
    newest = Window.partitionBy("applicant_id").orderBy(F.desc("scan"))
    scans = year_ranks(figures).withColumn("back", F.row_number().over(newest)).filter("back <= 2")
    two = figures.filter(F.col("figure").isin(*TRENDED)).join(scans, ["applicant_id", "fiscal_year"])
    pair = two.groupBy("applicant_id", "figure").agg(
        F.max(F.when(F.col("back") == 2, F.col("value"))).alias("old_value"),
        F.max(F.when(F.col("back") == 1, F.col("value"))).alias("new_value"))
    several = scans.filter("back = 2").select("applicant_id")
    change = F.when(
        F.col("old_value") != 0, (F.col("new_value") - F.col("old_value")) / F.abs("old_value") * 100)
    return pair.join(several, "applicant_id", "left_semi").withColumn("change", change).select(
        "applicant_id", "figure", "old_value", "new_value", F.round("change", 4).alias("change_pct"),
        F.when(F.col("change") > band, "improving").when(F.col("change") < -band, "deteriorating")
        .when(F.col("change").isNotNull(), "stable").alias("direction"))


def latest_year(scans: DataFrame) -> DataFrame:
    """Year label from the upload field name; the last label in text order is the current one.

    Of several files of that year the last name is taken.
    """
    label = F.when(F.col("field").contains("_"), F.upper(F.split_part("field", F.lit("_"), F.lit(2)))).otherwise(
        "LATEST")
    uploads = scans.filter(F.col("field").startswith("file") & (F.length("file_name") > 0))
    return uploads.withColumn("fiscal_year", label).groupBy("applicant_id").agg(
        F.max(F.struct("fiscal_year", "file_name")).alias("k"), F.count_distinct("fiscal_year").alias("years"),
    ).select("applicant_id", F.col("k.fiscal_year").alias("latest_year"), F.col("k.file_name").alias("file_name"), "years")


def ratios(figures: DataFrame, least_revenue: float = 100.0) -> DataFrame:
    """Debt/equity and EBITDA margin per scan; tiny revenue gives way to its comparative."""
    wide = figures.groupBy("applicant_id", "fiscal_year").agg(
        F.max(F.when(F.col("figure") == "Revenue", F.col("value"))).alias("revenue_read"),
        F.max(F.when(F.col("figure") == "Revenue", F.col("previous_value"))).alias("revenue_before"),
        F.max(F.when(F.col("figure") == "EBITDA", F.col("value"))).alias("ebitda"),
        F.max(F.when(F.col("figure") == "Total Debt", F.col("value"))).alias("debt"),
        F.max(F.when(F.col("figure") == "Net Worth", F.col("value"))).alias("net_worth"),
    )
    sane = F.col("revenue_read") >= least_revenue
    revenue = F.when(sane, F.col("revenue_read")).otherwise(F.col("revenue_before"))
    return wide.withColumn("revenue", revenue).select(
        "applicant_id", "fiscal_year", "revenue",
        F.when(sane, F.col("revenue_before")).alias("previous_revenue"), "ebitda", "debt", "net_worth",
        F.when((F.col("net_worth") != 0) & (F.col("debt") != 0), F.col("debt") / F.nullif("net_worth", F.lit(0.0)))
        .alias("debt_equity"),
        F.when((F.col("ebitda") != 0) & (F.col("revenue") > 0), F.col("ebitda") / F.nullif("revenue", F.lit(0.0)) * 100)
        .alias("ebitda_margin_pct"),
    )


def latest_auditor(history: DataFrame, extracted: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Newest auditor on record, else newest extracted one, else the one named in the text."""
    known = history.filter("auditor IS NOT NULL AND auditor <> ''").groupBy("applicant_id").agg(
        F.max_by("auditor", "fiscal_year").alias("recorded"))
    read = extracted.filter("auditor IS NOT NULL AND auditor <> ''").groupBy("applicant_id").agg(
        F.max_by("auditor", "fiscal_year").alias("extracted"))
    named = mentioned.filter("auditor IS NOT NULL AND auditor <> ''").groupBy("applicant_id").agg(
        F.max_by("auditor", "fiscal_year").alias("mentioned"))
    return known.join(read, "applicant_id", "full").join(named, "applicant_id", "full").select(
        "applicant_id", F.coalesce("recorded", "extracted", "mentioned").alias("auditor"),
        F.when(F.col("recorded").isNotNull(), "history").when(F.col("extracted").isNotNull(), "figures")
        .otherwise("text").alias("found_in"))


def best_per_group(candidates: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """Highest score per group; among equals the first in the given order."""
    place = Window.partitionBy(*keys).orderBy(F.desc(score), *order)
    return candidates.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")
