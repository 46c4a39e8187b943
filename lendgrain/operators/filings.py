"""Signals in report text: audit findings, figures, ratings, holdings, collateral, supply chain.

Every operator is one projection over ``documents`` (doc_id, text and any keys), so no
text is shuffled; finding tables come from exploding the arrays a projection built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions import text as tx
from lendgrain.functions.parsing import strip
from lendgrain.functions.spans import (
    labelled_spans, let, literal, snippet, spans, spans_sql, window_sql, window_text,
    without_marks,
)

TEXT = "text"
LOW = "_low"


def keys_of(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in (TEXT, LOW)]


def lowered(documents: DataFrame) -> DataFrame:
    """Add the lowered text the patterns run on; offsets equal those of the text.

    White space beyond ASCII, as in text from PDF files, becomes blanks, which the patterns know.
    """
    # Printable ASCII is passed over by one range test; the long class reads the few other characters.
    odd = F.col(LOW).rlike(f"(?=[^ -~])[{fv.UNICODE_SPACES}]")
    plain = F.when(odd, F.translate(LOW, fv.UNICODE_SPACES, " " * len(fv.UNICODE_SPACES))).otherwise(F.col(LOW))
    return documents.withColumn(LOW, tx.same_length_lower(F.col(TEXT))).withColumn(LOW, plain).withColumn(
        LOW, without_marks(F.col(LOW)))


# --- Audit report --------------------------------------------------------------------
def with_annexure(reports: DataFrame, annexures: DataFrame) -> DataFrame:
    """Audit report text followed by its annexure, where there is one."""
    extra = annexures.select("doc_id", F.col(TEXT).alias("_annexure"))
    joined = F.when(F.length(strip(F.col("_annexure"))) > 0, F.concat(
        F.col(TEXT), F.lit(fv.ANNEXURE_MARK), F.col("_annexure"))).otherwise(F.col(TEXT))
    return reports.join(extra, "doc_id", "left").withColumn(TEXT, joined).drop("_annexure")


def audit_spans(documents: DataFrame) -> DataFrame:
    """De-duplicated spans of statutory defaults, qualifications and emphasis paragraphs."""
    kinds = {
        "caro": [(fv.STATUTORY_LABEL, tx.for_lowered(p)) for p in fv.STATUTORY_PATTERNS],
        "qualification": [(label, p + fv.PARAGRAPH_REST) for label, p in fv.QUALIFICATION_PHRASES],
        "emphasis": [(label, p + fv.PARAGRAPH_REST) for label, p in fv.EMPHASIS_PHRASES],
    }
    return lowered(documents).select(*keys_of(documents), TEXT, *[labelled_spans(LOW, p).alias(f"_{kind}") for kind, p in kinds.items()])


def compliance_matches(documents: DataFrame) -> DataFrame:
    """One row per match with the text around it (400 characters in all, match included)."""
    spanned = audit_spans(documents)
    of_kind = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m"))
    tagged = F.concat(*[
        F.transform(F.col(f"_{kind}"), of_kind(kind)) for kind in ("caro", "qualification", "emphasis")])
    rows = spanned.select(*keys_of(documents), TEXT, F.explode(tagged).alias("f"))
    start, end = F.col("f.m.start"), F.col("f.m.end")
    padding = F.greatest(F.lit(0), F.floor((fv.SNIPPET_LENGTH - (end - start)) / 2)).cast("int")
    around = F.regexp_replace(F.regexp_replace(
        snippet(F.col(TEXT), start, end, padding, padding), r"\n{3,}", "\n\n"), " {3,}", " ")
    return rows.select(
        *keys_of(documents), F.col("f.kind").alias("kind"), F.col("f.m.label").alias("label"),
        start.alias("start"), end.alias("end"), around.alias("snippet"))


def compliance_flags(documents: DataFrame) -> DataFrame:
    """Flags, match counts and the rules they raise per document."""
    counted = audit_spans(documents).select(
        *keys_of(documents), F.size("_caro").alias("caro_matches"),
        F.size("_qualification").alias("qualification_matches"), F.size("_emphasis").alias("emphasis_matches"))
    caro, adverse, emphasis = (F.col(f"{k}_matches") > 0 for k in ("caro", "qualification", "emphasis"))
    return counted.select(
        "*", caro.alias("caro_default_found"), adverse.alias("adverse_opinion_found"),
        emphasis.alias("emphasis_of_matter_found"),
        F.array_compact(F.array(F.when(caro | adverse, "P-03"), F.when(emphasis, "P-04"))).alias("triggered_rules"))


# --- Financial figures ---------------------------------------------------------------
def crore_unit(context: Column) -> Column:
    """Unit named in the context; the larger unit words are looked for first."""
    low = F.lower(context)
    return (
        F.when(low.contains("lakh crore") | low.contains("lakh cr"), "Lakh Cr")
        .when(low.rlike(r"(?U)\b(bn|billion)\b"), "Bn_Cr").when(low.rlike(r"(?U)\b(crore|cr)\b"), "Cr")
        .when(low.rlike(r"(?U)\b(mn|million)\b"), "Mn_Cr").otherwise("unknown"))


def to_crore(value: Column, unit: Column) -> Column:
    scaled = F.when(unit == "Lakh Cr", value * 100_000).when(unit == "Bn_Cr", value * 100).when(
        unit == "Mn_Cr", value / 100).otherwise(value)
    return F.round(scaled, 2)


def _candidates() -> str:
    """All matches of all figures as one array, with the number read and the text around it."""
    parts = []
    for f, (name, (patterns, _)) in enumerate(fv.FIGURE_PATTERNS.items()):
        for n, (pattern, needles) in enumerate(zip(patterns, fv.FIGURE_NEEDLES[name], strict=True)):
            around = window_sql(TEXT, "m.start", "m.end", 100, 100)
            parts.append(
                f"transform({spans_sql(LOW, tx.for_lowered(pattern), 1, needles)}, m -> named_struct('figure', {f}, 'pattern', {n}, "
                "'start', m.start, 'end', m.end, 'text', m.text, 'raw', try_cast(regexp_replace(regexp_replace("
                f"replace(m.g1, ','), '[(]', '-'), '[)]', '') AS double), 'context', {around}))")
    return f"concat({', '.join(parts)})"


def _barred() -> str:
    """An exclusion counts only where it also shows inside the match, so the match alone decides."""
    cases = [
        f"WHEN c.figure = {f} THEN c.text RLIKE {literal('|'.join(f'(?:{p})' for p in exclude))}"
        for f, (_, exclude) in enumerate(fv.FIGURE_PATTERNS.values()) if exclude]
    return f"CASE {' '.join(cases)} ELSE false END"


SCALED = (
    "round(CASE c.unit WHEN 'Lakh Cr' THEN c.raw * 100000 WHEN 'Bn_Cr' THEN c.raw * 100 WHEN 'Mn_Cr' THEN c.raw / 100 "
    "ELSE c.raw END, 2)")
UNIT = (
    "CASE WHEN lower(c.context) LIKE '%lakh crore%' OR lower(c.context) LIKE '%lakh cr%' THEN 'Lakh Cr' "
    r"WHEN c.context RLIKE '(?iU)\\b(bn|billion)\\b' THEN 'Bn_Cr' WHEN c.context RLIKE '(?iU)\\b(crore|cr)\\b' THEN 'Cr' "
    r"WHEN c.context RLIKE '(?iU)\\b(mn|million)\\b' THEN 'Mn_Cr' ELSE 'unknown' END")
SCORE = (
    "IF(c.unit <> 'unknown', 40, 0) + IF(c.context RLIKE " + literal(fv.CURRENCY_SIGN) + ", 20, 0) + "
    "IF(abs(c.value) BETWEEN 10 AND 10000000, 20, 0) + IF(c.context RLIKE " + literal(fv.PAGE_HINT) + ", 10, 0) + "
    "IF(c.pattern = 0, 50, 0) + IF(abs(c.raw) > 10000, 15, 0)")


def extract_figures(documents: DataFrame) -> DataFrame:
    """Best candidate per figure and document, in crore, with its confidence.

    All candidates of a document sit in one array, are scored by one expression and
    sorted best first: higher score, then earlier pattern, then earlier position.
    """
    read = f"filter({_candidates()}, c -> abs(c.raw) >= 10 AND NOT ({_barred()}))"
    sized = (
        f"transform({read}, c -> named_struct('figure', c.figure, 'pattern', c.pattern, 'start', c.start, 'end', c.end, "
        f"'raw', c.raw, 'context', c.context, 'unit', {UNIT}))")
    valued = (
        f"transform({sized}, c -> named_struct('figure', c.figure, 'pattern', c.pattern, 'start', c.start, 'end', c.end, "
        f"'raw', c.raw, 'context', c.context, 'unit', c.unit, 'value', {SCALED}))")
    ranked = (
        f"transform({valued}, c -> named_struct('rank', -({SCORE}), 'pattern', c.pattern, 'start', c.start, 'end', c.end, "
        "'raw_value', c.raw, 'value', c.value, 'unit', c.unit, 'figure', c.figure))")
    scored = lowered(documents).select(*keys_of(documents), TEXT, F.expr(ranked).alias("_found"))
    # One expression per figure: read inside a lambda, the array would be computed again per element.
    best = "array(" + ", ".join(
        f"named_struct('figure', {literal(name)}, 'c', get(array_sort(filter(_found, c -> c.figure = {f} AND c.rank < 0)), 0))"
        for f, name in enumerate(fv.FIGURE_PATTERNS)) + ")"
    rows = scored.select(*keys_of(documents), TEXT, F.explode(F.expr(best)).alias("f")).filter("f.c IS NOT NULL")
    score = -F.col("f.c.rank")
    return rows.select(
        *keys_of(documents), F.col("f.figure").alias("figure"), F.col("f.c.value").alias("value"),
        F.col("f.c.raw_value").alias("raw_value"), F.col("f.c.unit").alias("unit"),
        F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW").alias("confidence"),
        score.alias("confidence_score"),
        F.concat(F.lit("..."), window_text(F.col(TEXT), F.col("f.c.start"), F.col("f.c.end"), 80, 80), F.lit("..."))
        .alias("snippet"))


def extract_auditor(documents: DataFrame) -> DataFrame:
    """Audit firm that signs in the last fifth of the text."""
    length = F.length(TEXT)
    tail = tx.collapse_space(F.substring(F.col(TEXT), F.floor(length * 0.8).cast("int") + 1, length))
    found = documents.withColumn("_tail", tail).withColumn(
        "_raw", F.regexp_extract("_tail", fv.AUDITOR_SIGNATURE, 1))
    firm = F.btrim(F.regexp_replace(strip(F.col("_raw")), fv.AUDITOR_TAIL, ""), F.lit(" ,."))
    at = F.regexp_instr(F.col("_tail"), F.lit(fv.AUDITOR_SIGNATURE)) - 1
    whole = F.regexp_extract("_tail", fv.AUDITOR_SIGNATURE, 0)
    return found.filter(F.length("_raw") > 0).select(
        *keys_of(documents), firm.alias("auditor"),
        F.concat(F.lit("..."), snippet(F.col("_tail"), at, at + F.length(whole), 30, 30), F.lit("...")).alias("snippet"),
    ).filter(F.length("auditor") < 100)


def mentioned_auditor(documents: DataFrame) -> DataFrame:
    """Firm named after "For" or "Sd/-" anywhere in the text."""
    return documents.select(
        *keys_of(documents), strip(F.regexp_extract(TEXT, fv.AUDITOR_MENTION, 1)).alias("auditor")
    ).filter(F.length("auditor") > 0)


# --- Ratings -------------------------------------------------------------------------
def _rating_array() -> Column:
    scale = ", ".join(literal(g) for g in fv.RATING_SCALE)
    # The look-ahead passes over letters no agency begins with.
    mention = "(?=[abci])" + tx.for_lowered(fv.RATING_MENTION)
    return F.expr(
        f"filter(transform({spans_sql(LOW, mention, 2, (fv.AGENCY_NEEDLE,))}, m -> named_struct('start', m.start, 'end', m.end, 'agency', "
        f"trim(substring({TEXT}, m.start + 1, length(m.g1))), "
        f"'grade', upper(trim(regexp_replace(m.g2, '[ ]*[(][^)]*[)]', ''))))), m -> m.grade IN ({scale}))")


def rating_mentions(documents: DataFrame, least_chars: int = 100) -> DataFrame:
    """Agency and grade mentions whose grade is on the scale, with outlook and snippet."""
    col = F.col(TEXT)
    rows = lowered(documents).filter(F.length(col) >= least_chars).select(*keys_of(documents), TEXT, F.explode(_rating_array()).alias("m"))
    start, end = F.col("m.start"), F.col("m.end")
    outlook = F.regexp_extract(window_text(col, start, end, 50, 100), fv.RATING_OUTLOOK, 1)
    return rows.select(
        *keys_of(documents), start.alias("start"), F.col("m.agency").alias("agency"), F.col("m.grade").alias("grade"),
        F.initcap(F.when(F.length(outlook) > 0, outlook)).alias("outlook"),
        F.col("m.grade").isin(*fv.INVESTMENT_GRADES).alias("is_investment_grade"),
        snippet(col, start, end, 20, 50).alias("snippet"))


def rating_status(documents: DataFrame, least_chars: int = 100) -> DataFrame:
    """Last mention of a document, downgrade wording, and the rule either raises.

    Texts under ``least_chars`` characters are not read; such a document has no rating and no rule.
    """
    col, low = F.col(TEXT), F.col(LOW)
    short = F.coalesce(F.length(col), F.lit(0)) < least_chars
    usable = lowered(documents.withColumn(TEXT, F.when(short, F.lit("")).otherwise(col)))
    last = F.try_element_at(_rating_array(), F.lit(-1))
    hit = F.coalesce(*[
        F.when(low.rlike(p), F.struct(
            (F.regexp_instr(low, F.lit(p)) - 1).alias("at"), F.length(F.regexp_extract(low, p, 0)).alias("size")))
        for p in map(tx.for_lowered, fv.DOWNGRADE_PATTERNS)])
    read = usable.select(*keys_of(documents), TEXT, last.alias("_last"), hit.alias("_hit"))
    outlook = F.regexp_extract(window_text(col, F.col("_last.start"), F.col("_last.end"), 50, 100), fv.RATING_OUTLOOK, 1)
    weak = F.col("latest_rating").isNotNull() & ~F.col("is_investment_grade")
    return read.select(
        *keys_of(documents), F.col("_last.agency").alias("latest_agency"), F.col("_last.grade").alias("latest_rating"),
        F.initcap(F.when(F.length(outlook) > 0, outlook)).alias("latest_outlook"),
        F.col("_last.grade").isin(*fv.INVESTMENT_GRADES).alias("is_investment_grade"),
        F.col("_hit").isNotNull().alias("downgrade_detected"),
        F.when(F.col("_hit").isNotNull(), snippet(col, F.col("_hit.at"), F.col("_hit.at") + F.col("_hit.size"), 30, 80))
        .alias("downgrade_details"),
    ).withColumn("triggered_rules", F.array_compact(F.array(
        F.when(F.coalesce(weak, F.lit(False)) | F.col("downgrade_detected"), "P-27"))))


# --- Shareholding --------------------------------------------------------------------
def _first_percent(section: Column, patterns: list[str]) -> Column:
    valid = [
        F.get(F.filter(
            F.transform(F.regexp_extract_all(section, F.lit(p), F.lit(1)), lambda g: g.try_cast("double")),
            lambda v: v.between(0.1, 100)), F.lit(0))
        for p in patterns]
    return F.round(F.coalesce(*valid), 2)


def shareholding(documents: DataFrame, section_length: int | None = fv.HOLDING_SECTION_LENGTH) -> DataFrame:
    """Holder percentages from the shareholding section, and the rules on pledge and holding.

    ``section_length``: characters of the section from its marker on; None reads to the end of the text.
    """
    low = F.col(LOW)
    length = F.length(low) if section_length is None else F.lit(section_length)
    picked = F.coalesce(*[
        let(F.substring(low, F.nullif(F.locate(marker, low), F.lit(0)), length),
            lambda s: F.when(s.rlike(r"\d+\.\d{2}"), s))
        for marker in fv.HOLDING_MARKERS], low)
    read = lowered(documents).withColumn("_section", picked).select(
        *keys_of(documents),
        *[_first_percent(F.col("_section"), patterns).alias(name) for name, patterns in fv.HOLDING_PATTERNS.items()])
    pledge, promoter = F.col("pledged_pct"), F.col("promoter_holding_pct")
    return read.select(
        "*", F.array_compact(F.array(F.when(pledge > 50, "P-17"), F.when(promoter < 26, "P-18"))).alias("triggered_rules"),
        F.array_compact(F.array(
            F.when(pledge > 50, F.concat(
                F.lit("High promoter pledge: "), pledge.cast("string"), F.lit("% of promoter shares pledged"))),
            F.when(promoter < 26, F.concat(
                F.lit("Low promoter holding: "), promoter.cast("string"), F.lit("% (below 26% threshold)"))),
        )).alias("findings"))


# --- Collateral ----------------------------------------------------------------------
def collateral(documents: DataFrame, unsecured_shown: int | None = 2, secured_shown: int | None = 3) -> DataFrame:
    """Unsecured and secured borrowing findings (None: all), counts, flags and the rule on unsecured loans."""
    col = F.col(TEXT)
    around = lambda m: snippet(col, m["start"], m["end"], 30, 80).alias("snippet")
    read = lowered(documents).select(
        *keys_of(documents), TEXT, spans(LOW, tx.for_lowered(fv.UNSECURED_PATTERN), 1).alias("_loose"),
        spans(LOW, tx.for_lowered(fv.SECURED_PATTERN), 3).alias("_tied"))
    loose = F.transform(tx.first_of(F.col("_loose"), unsecured_shown), lambda m: F.struct(
        F.lit("N/A").alias("asset_type"), F.lit("Unsecured").alias("security_type"), around(m)))
    tied = F.transform(tx.first_of(F.col("_tied"), secured_shown), lambda m: F.struct(
        F.initcap(m["g3"]).alias("asset_type"), F.initcap(m["g2"]).alias("security_type"), around(m)))
    has_loose, has_tied = F.size("_loose") > 0, F.size("_tied") > 0
    return read.select(
        *keys_of(documents), has_loose.alias("has_unsecured_loans"), (has_tied & ~has_loose).alias("is_fully_secured"),
        F.size("_loose").alias("unsecured_matches"), F.size("_tied").alias("secured_matches"),
        F.concat(loose, tied).alias("findings"),
        F.when(has_loose, "Significant unsecured borrowings detected.")
        .when(has_tied, "Borrowings appear predominantly secured.")
        .otherwise("No explicit collateral details found in text.").alias("summary"),
        F.array_compact(F.array(F.when(has_loose, "P-31"))).alias("triggered_rules"))


# --- Supply chain --------------------------------------------------------------------
def supply_features(documents: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """Flags, named counterparties and lists that describe the supply chain."""
    keywords = keywords or fv.SUPPLY_KEYWORDS
    flat = documents.withColumn("_flat", strip(tx.collapse_space(F.col(TEXT)))).withColumn(LOW, F.lower("_flat"))
    col, low = F.col("_flat"), F.col(LOW)
    flags = {name: tx.contains_any(low, words, lowered=True) for name, words in keywords.items()}
    supplier_share, customer_share = (
        tx.percent_near(low, phrase, lowered=True) >= least for phrase, least in (fv.SUPPLIER_SHARE, fv.CUSTOMER_SHARE))
    flags["supplier_concentration_high"] |= F.coalesce(supplier_share, F.lit(False))
    flags["customer_concentration_high"] |= F.coalesce(customer_share, F.lit(False))
    flags["receivables_stretched"] |= tx.days_jump(low, lowered=True)
    supplier, buyer = (
        tx.label_entity(col, labels, low) for labels in (fv.SUPPLIER_LABELS, fv.BUYER_LABELS))
    return flat.select(
        *keys_of(documents), supplier.alias("major_supplier"), buyer.alias("major_buyer"),
        tx.label_list(col, fv.PRODUCT_LABELS, lowered=low).alias("major_products"),
        tx.label_list(col, fv.MATERIAL_LABELS, lowered=low).alias("principal_raw_materials"),
        *[c.alias(n) for n, c in flags.items()],
    ).withColumns({
        "supplier_identified": F.col("major_supplier").isNotNull(), "buyer_identified": F.col("major_buyer").isNotNull()})


def risk_band(score: Column) -> Column:
    return F.when(score <= 20, "Low").when(score <= 40, "Moderate").otherwise("High")


def supply_scores(features: DataFrame) -> DataFrame:
    """Weighted supplier, buyer and overall scores with bands and the weakest link."""
    points = lambda flag, n: F.when(F.coalesce(flag, F.lit(False)), n).otherwise(0)
    scored = features.withColumns({
        "supplier_risk_score": points(F.col("commodity_exposure"), 20)
        + points(F.col("weather_exposure") | F.col("import_dependency"), 20)
        + points(F.col("supplier_concentration_high"), 20),
        "buyer_risk_score": points(F.col("customer_concentration_high"), 25)
        + points(F.col("buyer_payment_risk"), 20) + points(F.col("receivables_stretched"), 15)
        + points(F.col("buyer_type_is_weak_or_unorganized"), 10)})
    s, b = F.col("supplier_risk_score"), F.col("buyer_risk_score")
    overall = F.least(F.lit(100), F.greatest(s, b) + points((s > 20) & (b > 20), 10))
    return scored.withColumn("overall_supply_chain_risk_score", overall).withColumns({
        "supplier_risk_band": risk_band(s), "buyer_risk_band": risk_band(b),
        "overall_supply_chain_risk_band": risk_band(F.col("overall_supply_chain_risk_score")),
        "weakest_link": F.when(b > s, "Buyer concentration and payment reliability")
        .when(s > b, "Input/supplier-side dependence").otherwise("Both upstream and downstream dependencies")})


def supply_narrative(scored: DataFrame, shown: int = 4) -> DataFrame:
    """Reasons, confidence notes, one-line summary and memo paragraph."""
    fired = F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(flag), F.lit(False)), reason) for flag, reason in fv.SUPPLY_REASONS]))
    told = scored.withColumns({
        "reasons": F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit(fv.NO_SUPPLY_REASON))),
        "confidence_notes": F.array_compact(F.array(
            F.when(~F.col("supplier_identified"), fv.SUPPLIER_NOTE), F.when(~F.col("buyer_identified"), fv.BUYER_NOTE))),
        "major_supplier": F.coalesce("major_supplier", F.lit(fv.NOT_IDENTIFIED)),
        "major_buyer": F.coalesce("major_buyer", F.lit(fv.NOT_IDENTIFIED))})
    band, link = F.col("overall_supply_chain_risk_band"), F.col("weakest_link")
    opening = F.when(band == "Low", fv.SUPPLY_OPENINGS["Low"]).when(
        band == "Moderate", fv.SUPPLY_OPENINGS["Moderate"]).otherwise(
            F.format_string(fv.SUPPLY_OPENINGS["High"], F.lower(link)))
    return told.withColumns({
        "dashboard_summary": F.concat(
            F.lit("Supply Chain Risk: "), band, F.lit(" -- Weakest link is "), link, F.lit(".")),
        "memo_paragraph": F.concat(
            opening, F.lit(" Key indicators include "), F.array_join(F.slice("reasons", 1, shown), "; "), F.lit("."),
            F.when(F.size("confidence_notes") > 0, F.concat(F.lit(" "), F.array_join("confidence_notes", " ")))
            .otherwise(""))})
