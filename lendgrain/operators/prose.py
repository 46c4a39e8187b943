"""Signals in management prose: tone, ambidexterity, site notes and adverse media.

Whole-document projections; only adverse media shuffles, on its de-duplication key.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions import text as tx
from lendgrain.functions.parsing import strip
from lendgrain.functions.spans import let, literal
from lendgrain.operators.filings import TEXT, keys_of


# --- Tone ----------------------------------------------------------------------------
def lexicon_sentiment(
    documents: DataFrame, lexicon: dict[str, list[str]] | None = None, least_chars: int = 100,
) -> DataFrame:
    """(positive - negative) and (negative + uncertain) shares of the words, with the counts."""
    lexicon = lexicon or fv.TONE_LEXICON
    lowered = documents.withColumn("_low", F.regexp_replace(F.lower(TEXT), r"(?U)\s+", " "))
    counted = lowered.withColumn("_words", tx.word_tokens(F.col("_low"))).select(
        *keys_of(documents), (F.length(strip(F.col(TEXT))) >= least_chars).alias("_enough"),
        F.size("_words").alias("total_words"),
        *[tx.count_words(F.col("_words"), F.col("_low"), lexicon[k]).alias(f"{k}_words")
          for k in ("negative", "positive", "uncertain")])
    share = lambda n: F.round(F.try_divide(n, F.col("total_words")), 4)
    return counted.select(
        *keys_of(documents),
        F.when(~F.col("_enough"), "insufficient_text").when(F.col("total_words") == 0, "error").otherwise("success")
        .alias("status"),
        F.when(F.col("_enough"), share(F.col("positive_words") - F.col("negative_words"))).otherwise(0.0)
        .alias("sentiment_score"),
        F.when(F.col("_enough"), share(F.col("negative_words") + F.col("uncertain_words"))).otherwise(0.0)
        .alias("risk_intensity"),
        "total_words", "negative_words", "positive_words", "uncertain_words",
    ).withColumn("triggered_rules", F.array_compact(F.array(F.when(
        (F.col("status") == "success") & (F.col("sentiment_score") < -0.01), "P-16"))))


def headwinds(documents: DataFrame, markers: list[str] | None = None, k: int | None = 6) -> DataFrame:
    """First k sentences (None: all) over 40 characters that mention a headwind marker."""
    pattern = tx.alternation(markers or fv.HEADWIND_MARKERS)
    told = F.filter(
        F.split(F.col(TEXT), r"(?U)(?<=[.!?])\s+", -1), lambda s: (F.length(s) > 40) & F.lower(s).rlike(pattern))
    clean = F.transform(tx.first_of(told, k), lambda s: strip(tx.collapse_space(s)))
    return documents.select(*keys_of(documents), F.posexplode(clean).alias("pos", "sentence")).withColumn(
        "rank", F.col("pos") + 1).drop("pos")


# --- Ambidexterity -------------------------------------------------------------------
def keyword_counts(words: Column, lowered: Column, terms: list[str]) -> Column:
    """``array<struct<neg,pos,hits>>`` of the terms present, most frequent first.

    Single words are counted from the tokens that passed the hash lookup; only terms
    with other characters are searched as patterns.
    """
    lower = [t.lower() for t in terms]
    plain = [t for t in lower if re.fullmatch(r"\w+", t)]
    mixed = [(n, t) for n, t in enumerate(lower, 1) if not re.fullmatch(r"\w+", t)]
    literal = F.array(*map(F.lit, lower))
    single = let(F.filter(words, lambda w: w.isin(*plain)), lambda hits: F.transform(
        F.array_distinct(hits), lambda h: let(F.size(F.filter(hits, lambda w: w == h)), lambda n: F.struct(
            (-n).alias("neg"), F.array_position(literal, h).cast("int").alias("pos"), n.alias("hits")))))
    placed = lambda n: lambda c: F.struct((-c).alias("neg"), F.lit(n).alias("pos"), c.alias("hits"))
    multi = [let(tx.phrase_count(lowered, t), placed(n)) for n, t in mixed]
    found = F.concat(single, F.filter(F.array(*multi), lambda c: c["hits"] > 0)) if multi else single
    return F.array_sort(found)


def ambidexterity(documents: DataFrame, lexicon: dict[str, list[str]] | None = None, k: int | None = 10) -> DataFrame:
    """Exploration and exploitation frequencies, densities, their ratio and the top k keywords (None: all)."""
    lexicon = lexicon or fv.AMBIDEXTERITY_LEXICON
    sides = list(lexicon)
    prepared = documents.withColumn("_low", strip(F.regexp_replace(F.lower(TEXT), r"(?U)\s+", " ")))
    prepared = prepared.withColumn("_words", tx.word_tokens(F.col("_low")))
    prepared = prepared.withColumns({
        f"_{s}": keyword_counts(F.col("_words"), F.col("_low"), lexicon[s]) for s in sides})
    total = F.size("_words")
    hits = {s: F.aggregate(f"_{s}", F.lit(0), lambda acc, c: acc + c["hits"]) for s in sides}
    named = lambda terms: lambda c: F.struct(
        F.element_at(F.array(*map(F.lit, terms)), c["pos"]).alias("keyword"), c["hits"].alias("hits"))
    read = prepared.select(
        *keys_of(documents), total.alias("total_words"), *[hits[s].alias(f"{s}_frequency") for s in sides],
        *[F.transform(tx.first_of(F.col(f"_{s}"), k), named(lexicon[s])).alias(f"top_{s}_keywords") for s in sides])
    up, down = F.col(f"{sides[0]}_frequency"), F.col(f"{sides[1]}_frequency")
    density = lambda n: F.round(F.coalesce(F.try_divide(n, F.col("total_words")), F.lit(0.0)), 6)
    ratio = F.round(F.try_divide(up, down), 4)
    return read.withColumns({
        f"{sides[0]}_score": density(up), f"{sides[1]}_score": density(down), "ambidexterity_score": density(up + down),
        "ratio": ratio,
        "ratio_text": F.coalesce(ratio.cast("string"), F.when(
            up > 0, F.lit(f"∞ ({sides[1]}=0)")).otherwise("N/A"))})


# --- Site visits ---------------------------------------------------------------------
def site_visit_signals(notes: DataFrame, signals: list[tuple] | None = None, text: str = "notes") -> DataFrame:
    """One row per signal group that fires: its first matching pattern decides."""
    signals = signals or fv.SITE_SIGNALS
    rules = {r[0]: r for r in fv.RULES}
    keys = [c for c in notes.columns if c != text]

    def first_match(patterns: list[str], capacity: bool) -> str:
        reading = "coalesce(try_cast(regexp_extract(_low, {p}, 1) AS double), 0)" if capacity else "CAST(NULL AS double)"
        return "coalesce(" + ", ".join(
            f"CASE WHEN _low RLIKE {p} THEN named_struct('at', regexp_instr(_low, {p}) - 1, 'size', "
            f"length(regexp_extract(_low, {p}, 0)), 'reading', {reading.format(p=p)}) END"
            for p in (literal(f"(?U){tx.letter_first(q)}") for q in patterns)) + ")"

    def finding(rule_id: str, meaning: str, patterns: list[str]) -> str:
        capacity = rule_id == fv.CAPACITY_RULE
        _, name, bps, cut, _, severity, _ = rules[rule_id]
        fires = f"m IS NOT NULL AND m.reading < {fv.CAPACITY_THRESHOLD}" if capacity else "m IS NOT NULL"
        around = f"trim(substring({text}, greatest(m.at - 20, 0) + 1, m.at + m.size + 20 - greatest(m.at - 20, 0)))"
        return (
            f"get(transform(array({first_match(patterns, capacity)}), m -> CASE WHEN {fires} THEN named_struct("
            f"'rule_id', {literal(rule_id)}, 'rule_name', {literal(name)}, 'description', CASE WHEN m.reading > 0 THEN "
            f"format_string('Factory operating at %.0f%% capacity — below {fv.CAPACITY_THRESHOLD}%% threshold', m.reading) "
            f"ELSE {literal(meaning)} END, 'matched_text', {around}, 'severity', {literal(severity)}, "
            f"'rate_penalty_bps', {bps}, 'limit_reduction_pct', {cut}) END), 0)")

    groups = ", ".join(finding(*signal) for signal in signals)
    lowered = notes.withColumn("_low", tx.same_length_lower(F.col(text))).filter(F.length(strip(F.col(text))) > 0)
    return lowered.select(*keys, F.explode(F.expr(f"array_compact(array({groups}))")).alias("f")).select(*keys, "f.*")


def site_visit_totals(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Number of findings by severity, summed penalties and the one-line summary."""
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium"),
        F.sum("rate_penalty_bps").alias("total_penalty_bps"),
        F.sum("limit_reduction_pct").alias("total_limit_reduction_pct"),
        F.array_sort(F.collect_set("rule_id")).alias("triggered_rules"),
    ).withColumn("risk_summary", F.format_string(
        "%d site visit risk(s) detected — %d HIGH, %d MEDIUM. Total additional penalty: +%dbps, "
        "limit reduction: -%d%%", "findings", "high", "medium", "total_penalty_bps", "total_limit_reduction_pct"))


def site_visit_scan(notes: DataFrame, text: str = "notes") -> DataFrame:
    """Second scanner: capacity reading and literal red flags, all under one rule."""
    keys = [c for c in notes.columns if c != text]
    low = F.lower(text)
    read = notes.filter(F.length(strip(F.col(text))) > 0).withColumn(
        "capacity_pct", F.regexp_extract(F.col(text), r"(?iu)(\d+)\s*%\s*capac", 1).try_cast("int"))
    capacity = F.when(F.col("capacity_pct") < fv.CAPACITY_THRESHOLD, F.struct(
        F.format_string("Plant operating at %d%% capacity", "capacity_pct").alias("signal"),
        F.when(F.col("capacity_pct") < 40, "HIGH").otherwise("MEDIUM").alias("severity")))
    phrases = [F.when(low.contains(p), F.struct(F.lit(d).alias("signal"), F.lit("HIGH").alias("severity")))
               for p, d in fv.SITE_RED_FLAGS]
    return read.select(
        *keys, "capacity_pct", F.explode(F.array_compact(F.array(capacity, *phrases))).alias("f")
    ).select(*keys, "capacity_pct", "f.signal", "f.severity", F.lit("P-07").alias("rule_id"))


# --- Adverse media -------------------------------------------------------------------
def adverse_hits(
    blocks: DataFrame, weights: list[tuple[str, float]] | None = None, mitigants: list[str] | None = None,
    entity: str = "applicant_id", opening: int | None = 60, shown: int | None = 200,
) -> DataFrame:
    """Keyword hits per entity, one per keyword and sentence opening, in reading order.

    Sentences are one if their first ``opening`` characters agree, and ``shown`` characters of them are
    kept; None means the whole sentence.

    ``blocks``: entity, page_id, block_no, text (lowercase). Sentences and keywords
    expand inside the row; the only shuffle is the de-duplication, which combines on
    the map side, so one entity with very many pages stays spread out.
    """
    weights = weights or fv.MEDIA_WEIGHTS
    mitigants = fv.MEDIA_MITIGANTS if mitigants is None else mitigants
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(float(w)).alias("weight"), F.lit(n).alias("ord"))
                      for n, (k, w) in enumerate(weights)])
    sentences = blocks.select(entity, "page_id", "block_no", F.posexplode(
        F.split("text", r"(?U)[.!?;]\s+", -1)).alias("sentence_no", "raw")).withColumn("sentence", strip(F.col("raw")))
    any_keyword = tx.alternation([k for k, _ in weights])
    unmitigated = ~F.col("sentence").rlike(tx.alternation(mitigants)) if mitigants else F.lit(True)
    telling = sentences.filter((F.length("sentence") >= 20) & F.col("sentence").rlike(any_keyword) & unmitigated)
    hits = telling.select(
        entity, "page_id", "block_no", "sentence_no", "sentence",
        F.explode(F.filter(table, lambda k: F.col("sentence").contains(k["keyword"]))).alias("k"))
    first = F.struct("page_id", "block_no", "sentence_no")
    return hits.groupBy(
        entity, F.col("k.keyword").alias("keyword"), tx.first_chars(F.col("sentence"), opening).alias("opening")
    ).agg(
        F.min(first).alias("at"), F.min_by(tx.first_chars(F.col("sentence"), shown), first).alias("sentence"),
        F.first("k.weight").alias("weight"), F.first("k.ord").alias("ord"),
    ).select(entity, "at.*", "ord", "keyword", "weight", "sentence")


def adverse_media(hits: DataFrame, entity: str = "applicant_id", threshold: float = fv.MEDIA_THRESHOLD) -> DataFrame:
    """Weighted score and flag per entity."""
    return hits.groupBy(entity).agg(
        F.round(F.sum("weight"), 2).alias("raw_score"), F.count(F.lit(1)).alias("hit_count"),
        F.count_distinct("keyword").alias("keywords"),
    ).withColumn("adverse_media_found", F.col("raw_score") > threshold)


def shown_hits(hits: DataFrame, k: int = 10, entity: str = "applicant_id") -> DataFrame:
    """First k hits of an entity in reading order, for display."""
    order = Window.partitionBy(entity).orderBy("page_id", "block_no", "sentence_no", "ord")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
