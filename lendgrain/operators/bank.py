"""Bank statement signals: totals, counterparties, cash spikes, round trips, running balance.

Input ``txns``: applicant_id, seq (position in the statement), ts, date_str, description,
debit, credit, balance, party.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions.cumulative import running_sum
from lendgrain.functions.parsing import micros

DAY = 86_400_000_000


def statement_summary(txns: DataFrame) -> DataFrame:
    """Totals per applicant and the mean of its non-zero balances."""
    return txns.groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("debit").alias("total_debits"),
        F.sum("credit").alias("total_credits"),
        F.round(F.coalesce(F.avg(F.nullif("balance", F.lit(0.0))), F.lit(0.0)), 2).alias("avg_balance"),
    )


def counterparty_volumes(txns: DataFrame) -> DataFrame:
    """Debit, credit and total volume per counterparty, with its first position."""
    return (
        txns.filter("party IS NOT NULL").groupBy("applicant_id", "party")
        .agg(
            F.sum("debit").alias("debit_volume"), F.sum("credit").alias("credit_volume"),
            F.count(F.lit(1)).alias("txn_count"), F.min("seq").alias("first_seq"),
        )
        .withColumn("total_volume", F.col("debit_volume") + F.col("credit_volume"))
    )


def top_counterparties(volumes: DataFrame, k: int = 10) -> DataFrame:
    """Largest counterparties per applicant; equal volumes keep statement order.

    Spark limits each partition to k rows per applicant before the shuffle.
    """
    order = Window.partitionBy("applicant_id").orderBy(F.desc("total_volume"), "first_seq")
    return (
        volumes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select(
            "applicant_id", "rank", "party", F.round("total_volume", 2).alias("total_volume"),
            F.round("debit_volume", 2).alias("debit_volume"), F.round("credit_volume", 2).alias("credit_volume"),
            "txn_count",
        )
    )


def spike_threshold(txns: DataFrame) -> DataFrame:
    """Upper median of positive credits per applicant, and the spike threshold from it.

    Selection by histogram: counts per logarithmic bin locate the bin that holds the
    median rank, then only that bin is counted by value. No group ever holds more
    than the bins, or the distinct amounts of one bin, of an applicant.
    """
    credits = txns.filter("credit > 0").select(
        "applicant_id", "credit", F.floor(F.log2("credit") * 32).alias("bin"))
    all_bins = Window.partitionBy("applicant_id")
    bins = (
        credits.groupBy("applicant_id", "bin").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("reached", F.sum("n").over(all_bins.orderBy("bin")))
        .withColumn("rank", F.floor(F.sum("n").over(all_bins) / 2) + 1)
        .filter("reached >= rank AND reached - n < rank")
        .select("applicant_id", "bin", (F.col("rank") - (F.col("reached") - F.col("n"))).alias("rank_in_bin"))
    )
    located = credits.join(bins, ["applicant_id", "bin"])
    values = located.groupBy("applicant_id", "bin", "rank_in_bin", "credit").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("applicant_id", "bin").orderBy("credit")
    return (
        values.withColumn("reached", F.sum("n").over(within))
        .filter("reached >= rank_in_bin AND reached - n < rank_in_bin")
        .select(
            "applicant_id", F.col("credit").alias("median_credit"),
            F.greatest(F.col("credit") * fv.SPIKE_MULTIPLE, F.lit(fv.SPIKE_FLOOR)).alias("threshold"),
        )
    )


def cash_spikes(txns: DataFrame) -> DataFrame:
    """Large cash deposits up to three days ahead of a tax filing day of the same month.

    The floor of the threshold, the cash words and the calendar test come first, so
    only few rows meet the per-applicant threshold.
    """
    day = F.dayofmonth("ts")
    filing = F.lit(None).cast("int")
    for due in reversed(fv.FILING_DAYS):
        filing = F.when((due - day).between(0, fv.SPIKE_WINDOW_DAYS), F.lit(due)).otherwise(filing)
    lowered = F.lower("description")
    is_cash = F.lit(False)
    for word in fv.CASH_WORDS:
        is_cash = is_cash | lowered.contains(word)
    candidates = (
        txns.filter((F.col("credit") >= fv.SPIKE_FLOOR) & is_cash).withColumn("filing_day", filing)
        .filter("filing_day IS NOT NULL")
    )
    return candidates.join(spike_threshold(txns), "applicant_id").filter("credit >= threshold").select(
        "applicant_id", "seq", "date_str", F.col("credit").alias("amount"),
        F.date_format(
            F.make_date(F.year("ts"), F.month("ts"), F.col("filing_day")), "dd-MM-yyyy"
        ).alias("nearest_filing_date"),
        (F.col("filing_day") - F.dayofmonth("ts")).alias("days_before_filing"),
    )


def debit_matches(txns: DataFrame, days: int = fv.ROUND_TRIP_DAYS, min_amount: float = fv.ROUND_TRIP_MIN) -> DataFrame:
    """For each large debit, how many large credits of the same party lie within ``days``.

    The day gap is floored before its sign is dropped, so a debit matches credits in
    (debit - days - 1, debit + days]. The count is the difference of two running
    counts of credits, read at both ends of that interval: work grows with the rows,
    not with the pairs, and the running count is cut into time chunks.
    """
    usable = txns.filter("party IS NOT NULL AND ts IS NOT NULL").withColumn("at", micros(F.col("ts")))
    keys = ["applicant_id", "party"]
    # Credits of one instant count as one mark, however many there are.
    credits = usable.filter(F.col("credit") > min_amount).groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("one")).select(
        *keys, "at", F.lit(0).alias("probe"), "one", F.lit(None).cast("bigint").alias("seq"))
    end = lambda moved, probe: F.struct(
        (F.col("at") + moved * DAY).alias("at"), F.lit(probe).alias("probe"), F.lit(0).cast("bigint").alias("one"), F.col("seq"))
    probes = usable.filter(F.col("debit") > min_amount).select(*keys, F.inline(F.array(end(days, 1), end(-days - 1, -1))))
    marks = credits.unionByName(probes).withColumn("is_probe", F.abs("probe"))
    counted = running_sum(marks, keys, "at", ["is_probe", "seq"], "one", "credits_so_far")
    return (
        counted.filter("is_probe = 1").groupBy(*keys, "seq")
        .agg(F.sum(F.col("probe") * F.col("credits_so_far")).alias("matches"))
        .filter("matches > 0")
    )


def round_trip_counts(txns: DataFrame, **limits) -> DataFrame:
    """Exact number of round trips per applicant and party, without listing the pairs."""
    return debit_matches(txns, **limits).groupBy("applicant_id", "party").agg(
        F.sum("matches").alias("round_trips"), F.count(F.lit(1)).alias("matched_debits"))


def round_trips(
    txns: DataFrame, k: int = 10, days: int = fv.ROUND_TRIP_DAYS, min_amount: float = fv.ROUND_TRIP_MIN,
) -> DataFrame:
    """First k round trips per applicant: by first debit of the party, debit, then credit.

    k matched debits are enough to fill k places, so at most k debits per applicant
    meet the credits of their party; the list is exact and no full pairing is built.
    """
    keys = ["applicant_id", "party"]
    first_debit = (
        txns.filter("party IS NOT NULL AND debit > 0 AND ts IS NOT NULL")
        .groupBy(*keys).agg(F.min("seq").alias("party_seq"))
    )
    place = Window.partitionBy("applicant_id").orderBy("party_seq", "debit_seq")
    matched = (
        debit_matches(txns, days, min_amount).withColumnRenamed("seq", "debit_seq").join(first_debit, keys)
        .withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
        .select("applicant_id", "party", "party_seq", "debit_seq")
    )
    side = txns.filter("party IS NOT NULL").withColumn("at", micros(F.col("ts")))
    debits = side.filter(F.col("debit") > min_amount).select(
        "applicant_id", "party", F.col("seq").alias("debit_seq"), F.col("at").alias("debit_at"),
        F.col("date_str").alias("debit_date"), F.col("debit").alias("debit_amount"))
    credits = side.filter(F.col("credit") > min_amount).select(
        "applicant_id", "party", F.col("seq").alias("credit_seq"), F.col("at").alias("credit_at"),
        F.col("date_str").alias("credit_date"), F.col("credit").alias("credit_amount"))
    gap = F.abs(F.floor((F.col("debit_at") - F.col("credit_at")) / F.lit(DAY)))
    order = Window.partitionBy("applicant_id").orderBy("party_seq", "debit_seq", "credit_seq")
    # Only credits of the days around a debit meet it.
    day = F.floor(F.col("debit_at") / F.lit(DAY))
    near = debits.join(matched, ["applicant_id", "party", "debit_seq"]).withColumn("day", F.explode(F.sequence(day - days - 1, day + days)))
    return (
        near.join(credits.withColumn("day", F.floor(F.col("credit_at") / F.lit(DAY))), [*keys, "day"]).withColumn("days_gap", gap).filter(F.col("days_gap") <= days)
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select(
            "applicant_id", "rank", "party", "debit_date", "debit_amount", "credit_date", "credit_amount", "days_gap")
    )


def cap_findings(findings: DataFrame, order: list[str], k: int = 10, by: str = "applicant_id") -> DataFrame:
    """First k findings per applicant in the given order (the cap of a report)."""
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(
        F.col("rank") <= k)


def running_balance(txns: DataFrame, opening: float = 50_000.0) -> DataFrame:
    """Balance after each transaction in date order, from an opening balance."""
    moves = txns.withColumn("at", micros(F.col("ts"))).withColumn(
        "_move", F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0)))
    summed = running_sum(moves, ["applicant_id"], "at", ["seq"], "_move", "_sum")
    return summed.withColumn("balance", F.round(F.col("_sum") + F.lit(opening), 2)).drop("_move", "_sum", "at")


def merge_txns(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both statements as one; rows of the first go ahead where the dates are equal."""
    return first.withColumn("part", F.lit(0)).unionByName(
        second.withColumn("part", F.lit(1)), allowMissingColumns=True)


def statement_findings(txns: DataFrame) -> DataFrame:
    """Rules P-28 and P-29 with the finding text and the uncapped count behind each."""
    trips = (
        round_trip_counts(txns).groupBy("applicant_id").agg(F.sum("round_trips").alias("found"))
        .select("applicant_id", F.lit("P-28").alias("rule_id"), "found", F.format_string(
            f"CIRCULAR TRANSACTION: %d round-trip flows detected within {fv.ROUND_TRIP_DAYS}-day windows",
            "found").alias("finding"))
    )
    spikes = (
        cash_spikes(txns).groupBy("applicant_id").agg(F.count(F.lit(1)).alias("found"))
        .select("applicant_id", F.lit("P-29").alias("rule_id"), "found", F.format_string(
            f"CASH SPIKE: %d large cash deposits within {fv.SPIKE_WINDOW_DAYS} days of GST filing dates",
            "found").alias("finding"))
    )
    return trips.unionByName(spikes)
