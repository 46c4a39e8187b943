"""Counterparties, relationships, money loops, sector benchmark and screening.

Thresholds of the shell, relationship and benchmark rules are parameters: only their
inputs and outputs are prescribed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.session import settle


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N} ]", " "), r" +", " "))


def _containment_join(names: DataFrame, records: DataFrame, most_broadcast: int) -> DataFrame:
    """Pairs where ``key`` contains ``name`` or the reverse.

    A list counted to be short is broadcast. A longer one meets the names by an equality
    join: a text holds another only if it holds its first three characters.
    """
    hit = F.col("name").contains(F.col("key")) | F.col("key").contains(F.col("name"))
    if records.limit(most_broadcast + 1).count() <= most_broadcast:
        return names.join(F.broadcast(records), hit)
    grams = lambda c: F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))))

    # Texts of one or two characters have no three to meet on; they meet on one or two.
    def one_way(holder: DataFrame, whole: str, held: DataFrame, part: str) -> DataFrame:
        longer = holder.withColumn("gram", grams(F.col(whole)))
        exact = held.filter(F.length(part) >= 3).withColumn("gram", F.substring(part, 1, 3))
        short = held.filter(F.length(part) < 3)
        tiny = holder.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1))),
            lambda i: F.array(F.substring(F.col(whole), i, F.lit(1)), F.substring(F.col(whole), i, F.lit(2))))))))
        met = longer.join(exact, "gram").unionByName(tiny.join(short.withColumn("gram", F.col(part)), "gram"))
        return met.filter(F.col(whole).contains(F.col(part))).drop("gram")

    return one_way(names, "name", records, "key").unionByName(one_way(records, "key", names, "name")).distinct()


def screen_auditors(auditors: DataFrame, lists: DataFrame, most_broadcast: int = 10_000) -> DataFrame:
    """Blacklist and watchlist screening by containment in either direction.

    Distinct names are screened once and the verdict is joined back, so a name shared
    by many applicants costs one lookup. Blank list entries match nothing, repeated ones
    count once.
    """
    names = auditors.select(F.upper(F.trim("auditor")).alias("name")).filter("name <> ''").distinct()
    records = lists.withColumn("key", F.upper(F.trim("firm"))).filter("key <> ''").distinct()
    black, watch = F.col("list_type") == "BLACKLISTED", F.col("list_type") == "WATCHLIST"
    verdicts = _containment_join(names, records, most_broadcast).groupBy("name").agg(
        F.bool_or(black).alias("black"), F.bool_or(watch).alias("watch"), F.count(F.lit(1)).alias("n"))
    screened = auditors.withColumn("name", F.upper(F.trim("auditor"))).join(verdicts, "name", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    status = (
        F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "NOT_CHECKED").when(flag(F.col("black")), "BLACKLISTED")
        .when(flag(F.col("watch")), "WATCHLIST").otherwise("CLEAR"))
    return screened.select(
        *auditors.columns, status.alias("status"), flag(F.col("black")).alias("blacklisted"),
        flag(F.col("watch")).alias("watchlisted"), F.coalesce("n", F.lit(0).cast("bigint")).alias("records"),
    ).withColumn("message", F.when(F.col("status") == "NOT_CHECKED", "No auditor name extracted from annual report")
                 .when(F.col("status") == "BLACKLISTED", F.concat(
                     F.lit("ALERT: "), "auditor", F.lit(" appears on institutional blacklist")))
                 .when(F.col("status") == "WATCHLIST", F.concat(
                     F.lit("NOTICE: "), "auditor", F.lit(" is on enhanced monitoring watchlist")))
                 .otherwise(F.concat("auditor", F.lit(" — no adverse records found in institutional memory"))))


def profile_counterparties(counterparties: DataFrame, registry: DataFrame) -> DataFrame:
    """Counterparties with their registry record, matched on the normalised name."""
    known = registry.withColumn("_key", normal_name(F.col("name"))).drop("name")
    return (
        counterparties.withColumn("_key", normal_name(F.col("party"))).join(known, "_key", "left").drop("_key")
        .withColumn("registry_found", F.col("cin").isNotNull())
    )


def shell_suspects(
    profiles: DataFrame, least_capital: float = 100_000.0, bad_status: tuple[str, ...] = ("STRUCK OFF", "DORMANT"),
    address_words: tuple[str, ...] = ("VIRTUAL", "C/O"),
) -> DataFrame:
    """Reasons to suspect a shell company, and the flag if there is any."""
    reasons = F.array_compact(F.array(
        F.when(F.col("paid_up_capital") < least_capital, "Low paid-up capital"),
        F.when(F.upper("company_status").isin(*bad_status), F.concat(
            F.lit("Company status: "), "company_status")),
        F.when(F.upper("registered_address").rlike("|".join(address_words)), "Shared or virtual address")))
    return profiles.withColumn("shell_reasons", reasons).withColumn("is_shell_suspect", F.size("shell_reasons") > 0)


def _links(members: DataFrame, attribute: str, flag: str, severity: str) -> DataFrame:
    """Flags that tie every holder of a value to one hub, the applicant if it is among them.

    A value held by n entities yields n - 1 flags, not all pairs.
    """
    held = members.filter(F.col(attribute).isNotNull()).select("applicant_id", "role", "entity", attribute).distinct()
    hubs = held.groupBy("applicant_id", attribute).agg(
        F.min(F.struct((F.col("role") != "applicant").alias("far"), "entity")).alias("hub"),
        F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    return held.join(hubs, ["applicant_id", attribute]).filter("entity <> hub.entity").select(
        "applicant_id", F.lit(flag).alias("flag_type"), F.lit(severity).alias("severity"),
        F.col("hub.entity").alias("entity_a"), F.col("entity").alias("entity_b"),
        F.col(attribute).cast("string").alias("evidence"))


def relationship_flags(entities: DataFrame) -> DataFrame:
    """Shared directors, addresses and family names among an applicant and its counterparties.

    ``entities``: applicant_id, role, entity, directors (array), address.
    """
    people = entities.select("applicant_id", "role", "entity", F.explode("directors").alias("director"))
    people = people.withColumns({
        "director": normal_name(F.col("director")),
        "family": F.element_at(F.split(normal_name(F.col("director")), " "), -1)})
    placed = entities.withColumn("place", F.nullif(normal_name(F.col("address")), F.lit("")))
    return (
        _links(people, "director", "shared_director", "HIGH")
        .unionByName(_links(placed, "place", "same_address", "MEDIUM"))
        .unionByName(_links(people, "family", "family_name", "LOW")))


def circular_loops(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Money that goes round over two or three nodes, through the applicant or among its counterparties.

    ``edges``: applicant_id, src, dst, value; ``anchors``: applicant_id, node. Payments between
    two nodes become one link that points from the node with fewer links to the one with more
    (ties: by node), with the amount each way. A triangle is a pair of links that leave one node
    and a third between their ends. As no node sends out more than the root of twice the links,
    a hub with links to everyone forms no pairs, and all pairs stay within links ** 1.5.
    A loop of three is found once for each way round that is paid in full.

    ``path`` starts at the applicant if it is in the loop, else at the smallest node.
    """
    amount = lambda forward: F.sum(F.when((F.col("src") < F.col("dst")) == F.lit(forward), F.col("value")))
    links = edges.filter("src <> dst").groupBy(
        "applicant_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        amount(True).alias("ab"), amount(False).alias("ba"))
    links = settle(links)
    degrees = links.select("applicant_id", F.explode(F.array("a", "b")).alias("node")).groupBy("applicant_id", "node").agg(
        F.count(F.lit(1)).alias("links"))
    side = lambda name: degrees.select("applicant_id", F.col("node").alias(name), F.col("links").alias(f"{name}_links"))
    placed = links.join(side("a"), ["applicant_id", "a"]).join(side("b"), ["applicant_id", "b"])
    before = lambda x, y: F.struct(F.col(f"{x}_links").alias("links"), F.col(x).alias("node")) < F.struct(
        F.col(f"{y}_links").alias("links"), F.col(y).alias("node"))
    up = before("a", "b")
    pick = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    directed = settle(placed.select(
        "applicant_id", pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("b_links", "a_links").alias("v_links"),
        pick("ab", "ba").alias("out"), pick("ba", "ab").alias("back")))
    out = lambda v, *names: directed.select("applicant_id", "u", F.col("v").alias(v), F.col("v_links").alias(f"{v}_links"), *[
        F.col(c).alias(n) for c, n in zip(("out", "back"), names)])
    wedges = out("v", "uv", "vu").join(out("w", "uw", "wu"), ["applicant_id", "u"]).filter(
        before("v", "w") & (
            (F.col("uv").isNotNull() & F.col("wu").isNotNull()) | (F.col("uw").isNotNull() & F.col("vu").isNotNull())))
    third = directed.select("applicant_id", F.col("u").alias("v"), F.col("v").alias("w"), F.col("out").alias("vw"), F.col("back").alias("wv"))
    closed = wedges.select("applicant_id", "u", "v", "w", "uv", "vu", "uw", "wu").join(third, ["applicant_id", "v", "w"])
    paid = lambda nodes, *values: F.when(
        F.greatest(*[F.col(v).isNull().cast("int") for v in values]) == 0,
        F.struct(F.array(*nodes).alias("path"), F.least(*values).alias("loop_value")))
    three = closed.select("applicant_id", F.inline(F.array_compact(F.array(
        paid(("u", "v", "w"), "uv", "vw", "wu"), paid(("u", "w", "v"), "uw", "wv", "vu")))))
    two = links.filter("ab IS NOT NULL AND ba IS NOT NULL").select(
        "applicant_id", F.array("a", "b").alias("path"), F.least("ab", "ba").alias("loop_value"))
    known = two.unionByName(three).join(anchors.select("applicant_id", "node"), "applicant_id", "left")
    mine = F.coalesce(F.array_contains("path", F.col("node")), F.lit(False))
    first = F.array_position("path", F.when(mine, F.col("node")).otherwise(F.array_min("path"))).cast("int")
    turned = F.concat(F.slice("path", first, F.size("path")), F.slice("path", F.lit(1), first - 1))
    return known.select("applicant_id", turned.alias("path"), "loop_value", F.size("path").alias("length"), mine.alias("through_applicant"))


def loop_flags(loops: DataFrame) -> DataFrame:
    """Relationship flags of the money loops: the first node with each of the others on its way."""
    return loops.select(
        "applicant_id", F.lit("circular_loop").alias("flag_type"), F.lit("CRITICAL").alias("severity"),
        F.get("path", F.lit(0)).alias("entity_a"), F.explode(F.slice("path", 2, 2)).alias("entity_b"),
        F.array_join("path", " -> ").alias("evidence"))


def network_rules(flags: DataFrame) -> DataFrame:
    """Loop presence and the rule it raises per applicant."""
    return flags.groupBy("applicant_id").agg(
        F.bool_or(F.col("flag_type") == "circular_loop").alias("circular_trading_detected"),
        F.count(F.lit(1)).alias("flags"),
    ).withColumn("triggered_rules", F.array_compact(F.array(F.when(F.col("circular_trading_detected"), "P-06"))))


def profile_risk(profiles: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags touching each profile, whether a loop is among them, and the worst severity."""
    order = fv.FLAG_SEVERITY_ORDER
    touched = flags.select(
        "applicant_id", "flag_type", F.array_position(F.array(*map(F.lit, order)), F.col("severity")).alias("rank"),
        F.explode(F.array_distinct(F.array("entity_a", "entity_b"))).alias("party"))
    seen = touched.groupBy("applicant_id", "party").agg(
        F.count(F.lit(1)).alias("flag_count"), F.min("rank").alias("rank"),
        F.bool_or(F.col("flag_type") == "circular_loop").alias("in_loop"))
    return profiles.join(seen, ["applicant_id", "party"], "left").select(
        *profiles.columns, F.coalesce("flag_count", F.lit(0).cast("bigint")).alias("flag_count"),
        F.coalesce("in_loop", F.lit(False)).alias("in_loop"),
        F.coalesce(F.element_at(F.array(*map(F.lit, order)), F.col("rank").cast("int")), F.lit("LOW"))
        .alias("worst_severity"))


def rank_profiles(profiles: DataFrame) -> DataFrame:
    """Display order of profiles: loop members, shell suspects, then by number of flags."""
    order = Window.partitionBy("applicant_id").orderBy(
        F.desc("in_loop"), F.desc("is_shell_suspect"), F.desc("flag_count"), "party")
    return profiles.withColumn("rank", F.row_number().over(order))


def network_summary(profiles: DataFrame, flags: DataFrame) -> DataFrame:
    """Entities, registry hits, shells, loop flags and all flags per applicant."""
    counted = flags.groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("flags"), F.count_if(F.col("flag_type") == "circular_loop").alias("loop_flags"))
    zero = F.lit(0).cast("bigint")
    return profiles.groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if("registry_found").alias("registry_hits"),
        F.count_if("is_shell_suspect").alias("shells"),
    ).join(counted, "applicant_id", "left").select(
        "applicant_id", "entities", "registry_hits", "shells", F.coalesce("loop_flags", zero).alias("loop_flags"),
        F.coalesce("flags", zero).alias("flags"))


def benchmark(ratios: DataFrame, sectors: DataFrame, below_pct: float = 10.0, critical_pct: float = 25.0) -> DataFrame:
    """Deviation of each ratio from its sector, or from the DEFAULT sector where unknown.

    ``ratios``: applicant_id, sector, metric, company_value; ``sectors``: sector, metric,
    benchmark_value.
    """
    default = sectors.filter("sector = 'DEFAULT'").select("metric", F.col("benchmark_value").alias("_default"))
    known = sectors.select("sector", "metric", "benchmark_value").withColumn("_known", F.lit(True))
    joined = ratios.join(known, ["sector", "metric"], "left").join(default, "metric", "left")
    level = F.coalesce("benchmark_value", "_default")
    off = (F.col("company_value") - F.col("benchmark_value")) / F.abs(F.nullif("benchmark_value", F.lit(0.0))) * 100
    return joined.select(
        "applicant_id", F.when(F.col("_known"), F.col("sector")).otherwise("DEFAULT").alias("sector_used"), "metric",
        "company_value", level.alias("benchmark_value"),
    ).withColumn("off", off).select(
        "applicant_id", "sector_used", "metric", "company_value", "benchmark_value",
        F.round("off", 4).alias("deviation_pct"),
        F.when(F.col("off") < -critical_pct, "CRITICAL").when(F.col("off") < -below_pct, "BELOW").otherwise("OK")
        .alias("status"))


def benchmark_rules(compared: DataFrame) -> DataFrame:
    """Rule P-30 for applicants with a critical shortfall on any ratio."""
    return compared.groupBy("applicant_id").agg(
        F.count_if(F.col("status") == "CRITICAL").alias("critical"), F.count_if(F.col("status") == "BELOW").alias("below"),
    ).withColumn("triggered_rules", F.array_compact(F.array(F.when(F.col("critical") > 0, "P-30"))))


def with_fallback(found: DataFrame, default: DataFrame, empty: Column) -> DataFrame:
    """Rows of ``found``; applicants it lacks, or reports as empty, take the default row."""
    kept = found.filter(~F.coalesce(empty, F.lit(True)))
    return kept.withColumn("is_fallback", F.lit(False)).unionByName(
        default.join(kept, "applicant_id", "left_anti").withColumn("is_fallback", F.lit(True)))


def loan_purpose(applications: DataFrame, shares: DataFrame) -> DataFrame:
    """Stated purpose against where the money went.

    ``applications``: applicant_id, stated_purpose, activity; ``shares``: applicant_id,
    category, pct. Applicants without spending rows are judged as spending nothing.
    """
    of = lambda name: F.coalesce(F.max(F.when(F.col("category") == name, F.col("pct"))), F.lit(0.0))
    spent = shares.groupBy("applicant_id").agg(
        of("Related Party Transfers").alias("related"), of("Real Estate / Property").alias("property"),
        of("Vendor Payments (Raw Materials)").alias("vendors"),
        of("Unclassified / Cash Withdrawals").alias("unclassified"))
    purpose, activity = F.lower("stated_purpose"), F.lower("activity")
    working = purpose.rlike("working capital|operational|manufacturing")
    related, estate = F.col("related") > 15, working & (F.col("property") > 10)
    vendors, loose = working & (F.col("vendors") < 35), F.col("unclassified") > 10
    flag = lambda cond, name, severity, value, tail, head="": F.when(cond, F.struct(
        F.lit(name).alias("flag"), _literal(severity).alias("severity"),
        F.concat(F.lit(head), value.cast("string"), F.lit(tail)).alias("detail"),
        F.concat(value.cast("string"), F.lit("%")).alias("ground_truth_value")))
    flags = F.array_compact(F.array(
        flag(related, "HIGH_RELATED_PARTY_OUTFLOW", F.when(F.col("related") > 25, "HIGH").otherwise("MEDIUM"),
             F.col("related"), "% of bank outflows directed to related parties — inconsistent with stated working "
             "capital purpose"),
        flag(estate, "FUND_DIVERSION_REAL_ESTATE", "HIGH", F.col("property"),
             "% of funds routed to real estate/property despite stated purpose being working capital"),
        flag(vendors, "LOW_OPERATIONAL_SPEND", "MEDIUM", F.col("vendors"),
             "% of outflows to vendors/raw materials — expected >50% for genuine working capital usage", "Only "),
        flag(loose, "HIGH_UNCLASSIFIED_OUTFLOWS", "MEDIUM", F.col("unclassified"),
             "% of outflows are unclassified or cash withdrawals — cannot verify end-use")))
    status = F.when(estate | (F.col("related") > 25), "MISMATCH").when(
        related | vendors | loose, "PARTIAL_MISMATCH").otherwise("MATCH")
    aligned = activity.rlike("textile|manufactur|steel|chemical|pharma") & purpose.rlike(
        "working capital|manufactur|operational")
    names = F.array_join(F.transform(F.slice("flags", 1, 2), lambda f: F.initcap(F.lower(
        F.replace(f["flag"], F.lit("_"), F.lit(" "))))), ", ")
    alignment = F.concat(
        F.when(aligned, "Stated purpose consistent with MCA activity: '").otherwise(
            "Stated purpose may not align with MCA activity: '"), F.initcap(activity), F.lit("'"))
    use = F.array_sort(F.collect_list(F.struct((-F.col("pct")).alias("_order"), "category", F.col("pct").alias("percentage"))))
    used = shares.groupBy("applicant_id").agg(F.transform(
        use, lambda u: F.struct(u["category"].alias("category"), u["percentage"].alias("percentage"))).alias("fund_utilization"))
    rated = applications.join(spent, "applicant_id", "left").fillna(
        0.0, ["related", "property", "vendors", "unclassified"]).join(used, "applicant_id", "left")
    return rated.select(
        "applicant_id", "stated_purpose", "activity", status.alias("overall_status"), flags.alias("flags"),
        aligned.alias("aligned"), alignment.alias("alignment_detail"), "fund_utilization",
        F.array_compact(F.array(F.when(status == "MISMATCH", "P-34"))).alias("triggered_rules"),
    ).withColumn("verdict", F.when(F.col("overall_status") == "MATCH", F.concat(
        F.lit("Fund utilization pattern is consistent with the stated purpose: '"), "stated_purpose", F.lit("'")))
        .when(F.col("overall_status") == "PARTIAL_MISMATCH", F.concat(
            F.lit("Partial concerns detected — "), names, F.lit(". Recommend enhanced monitoring of fund end-use.")))
        .otherwise(F.concat(F.lit("Significant fund diversion signals — "), names,
                            F.lit(". Recommend end-use audit before disbursement."))))


def _literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def rank_categories(shares: DataFrame) -> DataFrame:
    """Spending categories of an applicant by share."""
    order = Window.partitionBy("applicant_id").orderBy(F.desc("pct"), "category")
    return shares.withColumn("rank", F.row_number().over(order))
