"""Filing text queries: audit, figures, ratings, holdings, collateral, supply chain."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions import text as tx
from lendgrain.operators import filings, financials
from lendgrain.plans.bindings import AUDITORS, DOCS, FILINGS, auditors
from lendgrain.plans.registry import query

WITH = f"WITH {FILINGS.cte}"
EXACT = "CAST(round(CAST(CAST({} AS VARCHAR) AS DECIMAL(38, 20)), {}) AS DOUBLE)"


def re2(pattern: str) -> str:
    """A pattern for the checking engine as an SQL literal."""
    pattern = re.sub(r"^\(\?iu\)", "", pattern).replace(r"(?=\n\n|\z)", r"(?:\n\n|\z)")
    return "'" + pattern.replace("'", "''") + "'"


def any_match(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, {re2(p)}, 'i')" for p in patterns) + ")"


def documents(spark, sf_dir):
    return FILINGS.frame(spark, sf_dir)


def around_sql(text: str, match: str, before: int, after: int) -> str:
    """Text around the first place of a match."""
    at = f"(strpos({text}, {match}) - 1)"
    low = f"greatest({at} - {before}, 0)"
    return f"substr({text}, {low} + 1, least(length({text}), {at} + length({match}) + {after}) - {low})"


# --- Audit report --------------------------------------------------------------------
PARAGRAPH = lambda phrases: [rf"(?iu){p}{fv.PARAGRAPH_REST}" for _, p in phrases]
AUDIT = f"""flags AS (SELECT doc_id, applicant_id, fiscal_year, {any_match(fv.STATUTORY_PATTERNS)} AS caro,
  {any_match(PARAGRAPH(fv.QUALIFICATION_PHRASES))} AS adv, {any_match(PARAGRAPH(fv.EMPHASIS_PHRASES))} AS eom FROM filings)"""


@query("compliance_flags", f"""{WITH}, {AUDIT}
SELECT doc_id, applicant_id, fiscal_year, caro AS caro_default_found, adv AS adverse_opinion_found,
  eom AS emphasis_of_matter_found, CAST(caro AS INTEGER) AS caro_matches, CAST(adv AS INTEGER) AS qualification_matches,
  CAST(eom AS INTEGER) AS emphasis_matches,
  concat_ws(',', CASE WHEN caro OR adv THEN 'P-03' END, CASE WHEN eom THEN 'P-04' END) AS triggered_rules FROM flags""")
def compliance_flags(spark, sf_dir):
    return filings.compliance_flags(documents(spark, sf_dir)).withColumn("triggered_rules", F.array_join("triggered_rules", ","))


# Passages are a known distance apart, so the first match of each phrase can be placed by search.
@query("compliance_matches", f"""{WITH},
m AS (SELECT doc_id, 'qualification' AS kind, 'Except for' AS label, strpos(text, 'Except for') - 1 AS start,
   strpos(text, 'Except for') - 1 + length(regexp_extract(text, '(?i)(except\\s+for[\\s\\S]{{0,300}}?)(?:\\n\\n|\\z)', 1)) AS "end"
   FROM filings WHERE text LIKE '%Except for%'
 UNION ALL SELECT doc_id, 'emphasis', 'Material Uncertainty', strpos(text, 'material uncertainty') - 1,
   strpos(text, 'material uncertainty') - 1 +
   length(regexp_extract(text, '(?i)(material\\s+uncertainty[\\s\\S]{{0,300}}?)(?:\\n\\n|\\z)', 1))
   FROM filings WHERE text LIKE '%material uncertainty%'
 UNION ALL SELECT doc_id, 'caro', '{fv.STATUTORY_LABEL}', strpos(text, 'statutory dues') - 1,
   strpos(text, 'statutory dues') - 1 + length(regexp_extract(text, {re2(fv.STATUTORY_PATTERNS[1])}, 0, 'i'))
   FROM filings WHERE text LIKE '%statutory dues%')
SELECT m.doc_id, applicant_id, fiscal_year, kind, label, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end",
  trim(substr(text, greatest(start - (400 - ("end" - start)) // 2, 0) + 1,
    least(length(text), "end" + (400 - ("end" - start)) // 2) - greatest(start - (400 - ("end" - start)) // 2, 0)),
    ' ' || chr(10)) AS snippet
FROM m JOIN filings USING (doc_id)""")
def compliance_matches(spark, sf_dir):
    return filings.compliance_matches(documents(spark, sf_dir))


@query("annexed_reports", f"""{WITH}, {{}}
SELECT a.doc_id, length(a.text) + CASE WHEN length(trim(b.text)) > 0 THEN 20 + length(b.text) ELSE 0 END AS chars
FROM filings a LEFT JOIN docs b ON a.doc_id = b.doc_id""".replace("{}", DOCS.cte))
def annexed_reports(spark, sf_dir):
    joined = filings.with_annexure(documents(spark, sf_dir), DOCS.frame(spark, sf_dir))
    return joined.select("doc_id", F.length("text").cast("bigint").alias("chars"))


# --- Financial figures ---------------------------------------------------------------
def figure_sql(figure: str) -> str:
    """The first pattern of a figure, whose priority bonus beats any later one here."""
    p = re2(fv.FIGURE_PATTERNS[figure][0][0])
    return f"""(SELECT doc_id, '{figure}' AS figure, m, raw, ctx, CASE
      WHEN ctx LIKE '%lakh crore%' OR ctx LIKE '%lakh cr%' THEN 'Lakh Cr'
      WHEN regexp_matches(ctx, '\\b(bn|billion)\\b') THEN 'Bn_Cr' WHEN regexp_matches(ctx, '\\b(crore|cr)\\b') THEN 'Cr'
      WHEN regexp_matches(ctx, '\\b(mn|million)\\b') THEN 'Mn_Cr' ELSE 'unknown' END AS unit
    FROM (SELECT doc_id, m, TRY_CAST(replace(replace(replace(g, ',', ''), '(', '-'), ')', '') AS DOUBLE) AS raw,
      lower(substr(text, greatest(strpos(text, m) - 101, 0) + 1,
        least(length(text), strpos(text, m) - 1 + length(m) + 100) - greatest(strpos(text, m) - 101, 0))) AS ctx
      FROM (SELECT doc_id, text, regexp_extract(text, {p}, 0, 'i') AS m, regexp_extract(text, {p}, 1, 'i') AS g FROM filings)
      WHERE m <> ''))"""


FIGURES = " UNION ALL ".join(figure_sql(f) for f in fv.FIGURE_PATTERNS)


@query("extracted_figures", f"""{WITH}, f AS ({FIGURES}),
v AS (SELECT *, {EXACT.format("CASE unit WHEN 'Lakh Cr' THEN raw * 100000 WHEN 'Bn_Cr' THEN raw * 100 WHEN 'Mn_Cr' THEN raw / 100 ELSE raw END", 2)}
  AS value FROM f WHERE abs(raw) >= 10),
s AS (SELECT *, CASE WHEN unit <> 'unknown' THEN 40 ELSE 0 END + CASE WHEN regexp_matches(ctx, '[`₹\\$]') THEN 20 ELSE 0 END
  + CASE WHEN abs(value) BETWEEN 10 AND 10000000 THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(ctx, 'page|p\\.\\d+|\\d{{1,3}}\\s*$') THEN 10 ELSE 0 END + 50
  + CASE WHEN abs(raw) > 10000 THEN 15 ELSE 0 END AS score FROM v)
SELECT doc_id, applicant_id, fiscal_year, figure, value, raw AS raw_value, unit,
  CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  score AS confidence_score, '...' || {around_sql("text", "m", 80, 80)} || '...' AS snippet FROM s JOIN filings USING (doc_id)""")
def extracted_figures(spark, sf_dir):
    return filings.extract_figures(documents(spark, sf_dir))


@query("unit_conversion", """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS v,
  'Total ' || CASE l_linenumber % 6 WHEN 0 THEN 'Lakh Crore' WHEN 1 THEN 'bn' WHEN 2 THEN 'Cr.' WHEN 3 THEN 'million'
  WHEN 4 THEN 'crowd' ELSE 'abn 5 mn' END AS ctx FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN ctx LIKE '%Lakh Cr%' THEN 'Lakh Cr' WHEN ctx = 'Total bn' THEN 'Bn_Cr'
  WHEN ctx = 'Total Cr.' THEN 'Cr' WHEN ctx LIKE '%million' OR ctx LIKE '%mn' THEN 'Mn_Cr' ELSE 'unknown' END AS unit,
  CAST(round(CASE WHEN ctx LIKE '%Lakh Cr%' THEN v * 100000 WHEN ctx = 'Total bn' THEN v * 100
  WHEN ctx LIKE '%million' OR ctx LIKE '%mn' THEN CAST(CAST(round(v) AS BIGINT) AS DOUBLE) / 100 ELSE v END) AS BIGINT) AS crore FROM t""")
def unit_conversion(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice AS v",
        "'Total ' || CASE l_linenumber % 6 WHEN 0 THEN 'Lakh Crore' WHEN 1 THEN 'bn' WHEN 2 THEN 'Cr.' WHEN 3 THEN "
        "'million' WHEN 4 THEN 'crowd' ELSE 'abn 5 mn' END AS ctx"
    ).withColumn("unit", filings.crore_unit(F.col("ctx")))
    whole = F.when(F.col("unit") == "Mn_Cr", F.round("v")).otherwise(F.col("v"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "unit", F.round(
        filings.to_crore(whole, F.col("unit"))).cast("bigint").alias("crore"))


AUDITOR_SQL = f"""tails AS (SELECT doc_id, applicant_id, fiscal_year, regexp_replace(
  substr(text, CAST(floor(length(text) * CAST(0.8 AS DOUBLE)) AS BIGINT) + 1), '\\s+', ' ', 'g') AS tail FROM filings),
sig AS (SELECT *, regexp_extract(tail, {re2(fv.AUDITOR_SIGNATURE)}, 1, 'i') AS raw, regexp_extract(tail, {re2(fv.AUDITOR_SIGNATURE)}, 0, 'i') AS m
  FROM tails), signed AS (SELECT doc_id, applicant_id, fiscal_year,
  trim(regexp_replace(trim(raw), '(?i)(?:firm|registration).*$', ''), ' ,.') AS auditor,
  '...' || trim({around_sql("tail", "m", 30, 30)}) || '...' AS snippet FROM sig WHERE raw <> '')"""


@query("extracted_auditors", f"{WITH}, {AUDITOR_SQL} SELECT * FROM signed WHERE length(auditor) < 100")
def extracted_auditors(spark, sf_dir):
    return filings.extract_auditor(documents(spark, sf_dir))


@query("latest_auditor", f"""{WITH}, {AUDITOR_SQL}, {AUDITORS.cte},
h AS (SELECT applicant_id, arg_max(auditor, fiscal_year) AS a FROM (SELECT DISTINCT * FROM auditor_rows)
  WHERE auditor <> '' GROUP BY 1),
e AS (SELECT applicant_id, max({{'k': fiscal_year || '|' || auditor, 'a': auditor}}).a AS a FROM signed
  WHERE length(auditor) < 100 AND auditor <> '' GROUP BY 1),
m AS (SELECT applicant_id, max({{'k': fiscal_year || '|' || auditor, 'a': auditor}}).a AS a FROM (
  SELECT applicant_id, fiscal_year, trim(regexp_extract(text, {re2(fv.AUDITOR_MENTION)}, 1)) AS auditor FROM filings)
  WHERE auditor <> '' GROUP BY 1)
SELECT applicant_id, coalesce(h.a, e.a, m.a) AS auditor,
  CASE WHEN h.a IS NOT NULL THEN 'history' WHEN e.a IS NOT NULL THEN 'figures' ELSE 'text' END AS found_in
FROM h FULL JOIN e USING (applicant_id) FULL JOIN m USING (applicant_id)""")
def latest_auditor(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # Several filings of one year: the later name in text order stands for the year.
    per_year = lambda rows: rows.groupBy("applicant_id", "fiscal_year").agg(F.max("auditor").alias("auditor"))
    return financials.latest_auditor(
        auditors(spark, sf_dir), per_year(filings.extract_auditor(docs).filter("auditor <> ''")),
        per_year(filings.mentioned_auditor(docs)))


# --- Ratings -------------------------------------------------------------------------
SCALE = ", ".join(f"'{g}'" for g in fv.RATING_SCALE)
GOOD = ", ".join(f"'{g}'" for g in fv.INVESTMENT_GRADES)
RATED = f"""rated AS (SELECT doc_id, applicant_id, fiscal_year, text,
  unnest(regexp_extract_all(text, {re2(fv.RATING_MENTION)}, 0, 'i')) AS m,
  unnest(regexp_extract_all(text, {re2(fv.RATING_MENTION)}, 1, 'i')) AS agency,
  unnest(regexp_extract_all(text, {re2(fv.RATING_MENTION)}, 2, 'i')) AS g FROM filings WHERE length(text) >= 100),
graded AS (SELECT *, upper(trim(regexp_replace(g, '\\s*\\([^)]*\\)', ''))) AS grade FROM rated),
valid AS (SELECT * FROM graded WHERE grade IN ({SCALE}))"""


@query("rating_mentions", f"""{WITH}, {RATED}
SELECT doc_id, applicant_id, fiscal_year, CAST(strpos(text, m) - 1 AS INTEGER) AS start, agency, grade,
  CASE WHEN regexp_matches(substr(text, strpos(text, m), length(m) + 100), '(?i)outlook: stable') THEN 'Stable' END AS outlook,
  grade IN ({GOOD}) AS is_investment_grade,
  trim(substr(text, greatest(strpos(text, m) - 21, 0) + 1, least(length(text), strpos(text, m) - 1 + length(m) + 50)
    - greatest(strpos(text, m) - 21, 0)), ' ' || chr(10)) AS snippet FROM valid""")
def rating_mentions(spark, sf_dir):
    return filings.rating_mentions(documents(spark, sf_dir))


DOWNGRADE = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {re2(p)}, 0, 'i'), '')" for p in fv.DOWNGRADE_PATTERNS) + ")"
DOWNGRADED = f"trim({around_sql('text', DOWNGRADE, 30, 80)}, ' ' || chr(10))"


@query("rating_status", f"""{WITH}, {RATED},
d AS (SELECT doc_id, applicant_id, fiscal_year, text, length(text) >= 100 AND {any_match(fv.DOWNGRADE_PATTERNS)} AS down FROM filings),
l AS (SELECT doc_id, arg_max(grade, strpos(text, m)) AS grade, arg_max(agency, strpos(text, m)) AS agency FROM valid GROUP BY 1)
SELECT d.doc_id, applicant_id, fiscal_year, agency AS latest_agency, grade AS latest_rating,
  CASE WHEN grade IS NOT NULL THEN 'Stable' END AS latest_outlook, grade IN ({GOOD}) AS is_investment_grade,
  down AS downgrade_detected, CASE WHEN down THEN {DOWNGRADED} END AS downgrade_details, CASE WHEN down OR coalesce(grade NOT IN ({GOOD}), false) THEN 'P-27' ELSE '' END
  AS triggered_rules FROM d LEFT JOIN l USING (doc_id)""")
def rating_status(spark, sf_dir):
    return filings.rating_status(documents(spark, sf_dir)).withColumn(
        "triggered_rules", F.array_join("triggered_rules", ","))


# --- Shareholding and collateral -----------------------------------------------------
def holder_sql(patterns: list[str]) -> str:
    first = lambda p: (
        f"list_filter(list_transform(regexp_extract_all(text, {re2(p)}, 1, 'i'), lambda x: TRY_CAST(x AS DOUBLE)), "
        "lambda x: x BETWEEN 0.1 AND 100)[1]")
    return "round(coalesce(" + ", ".join(first(p) for p in patterns) + "), 2)"


@query("shareholding", f"""{WITH}, h AS (SELECT doc_id, applicant_id, fiscal_year,
  {", ".join(f"{holder_sql(p)} AS {n}" for n, p in fv.HOLDING_PATTERNS.items())} FROM filings)
SELECT *, concat_ws(',', CASE WHEN pledged_pct > 50 THEN 'P-17' END, CASE WHEN promoter_holding_pct < 26 THEN 'P-18' END)
  AS triggered_rules, concat_ws('; ', CASE WHEN pledged_pct > 50 THEN 'High promoter pledge: ' || pledged_pct || '% of promoter shares pledged' END,
  CASE WHEN promoter_holding_pct < 26 THEN 'Low promoter holding: ' || promoter_holding_pct || '% (below 26% threshold)' END) AS findings FROM h""")
def shareholding(spark, sf_dir):
    return filings.shareholding(documents(spark, sf_dir)).withColumns({
        "triggered_rules": F.array_join("triggered_rules", ","), "findings": F.array_join("findings", "; ")})


LOOSE, TIED = ("nullif(regexp_extract(text, {}, 0, 'i'), '')".format(re2(p)) for p in (fv.UNSECURED_PATTERN, fv.SECURED_PATTERN))
TIED_PART = lambda n: f"lower(regexp_extract(text, {re2(fv.SECURED_PATTERN)}, {n}, 'i'))"


@query("collateral", f"""{WITH}, c AS (SELECT doc_id, applicant_id, fiscal_year, text,
  len(regexp_extract_all(text, {re2(fv.UNSECURED_PATTERN)}, 0, 'i')) AS u,
  len(regexp_extract_all(text, {re2(fv.SECURED_PATTERN)}, 0, 'i')) AS s FROM filings)
SELECT doc_id, applicant_id, fiscal_year, u > 0 AS has_unsecured_loans, s > 0 AND u = 0 AS is_fully_secured,
  CAST(u AS INTEGER) AS unsecured_matches, CAST(s AS INTEGER) AS secured_matches,
  CAST(least(u, 2) + least(s, 3) AS INTEGER) AS shown,
  concat_ws('; ', CASE WHEN u > 0 THEN 'n/a|unsecured|' || trim({around_sql("text", LOOSE, 30, 80)}, ' ' || chr(10)) END,
    CASE WHEN s > 0 THEN {TIED_PART(3)} || '|' || {TIED_PART(2)} || '|' || trim({around_sql("text", TIED, 30, 80)}, ' ' || chr(10)) END) AS findings,
  CASE WHEN u > 0 THEN 'Significant unsecured borrowings detected.'
    WHEN s > 0 THEN 'Borrowings appear predominantly secured.' ELSE 'No explicit collateral details found in text.' END
  AS summary, CASE WHEN u > 0 THEN 'P-31' ELSE '' END AS triggered_rules FROM c""")
def collateral(spark, sf_dir):
    return filings.collateral(documents(spark, sf_dir)).withColumns({
        "shown": F.size("findings"), "triggered_rules": F.array_join("triggered_rules", ","), "findings": F.array_join(F.transform(
            "findings", lambda f: F.concat_ws("|", F.lower(f["asset_type"]), F.lower(f["security_type"]), f["snippet"])), "; ")})


# --- Supply chain --------------------------------------------------------------------
NEGATED = "(?:no|not|without|nil|none|absence of)[^.;,\\n]{0,25}$"


def keyword_sql(words: list[str]) -> str:
    """True if some occurrence of some word has no negator in the 35 characters before it."""
    one = lambda w: (
        f"(contains(low, '{w}') AND list_bool_or(list_transform(range(1, len(string_split(low, '{w}'))), lambda i: "
        f"NOT regexp_matches(right(array_to_string(list_slice(string_split(low, '{w}'), 1, i), '{w}'), 35), '{NEGATED}'))))")
    return "(" + " OR ".join(one(w) for w in words) + ")"


def percent_sql(phrase: str) -> str:
    return f"TRY_CAST(regexp_extract(flat, '{phrase}[^%\\n]{{0,80}}?(\\d{{1,3}})\\s*%', 1, 'i') AS INTEGER)"


def entity_sql(labels: list[str]) -> str:
    verbs = "\\b(concentration|accounts? for|contributed|reported|remained|increased)\\b"
    raw = lambda l: f"regexp_extract(flat, '{l}(?:s)?\\s*(?:include|is|are)\\s*[:\\-]?\\s*([^.\\n]+)', 1, 'i')"
    clean = lambda l: f"trim({raw(l)}, ' .,:;')"
    return "CASE " + " ".join(
        f"WHEN {raw(l)} <> '' AND NOT regexp_matches({clean(l)}, '{verbs}', 'i') THEN nullif({clean(l)}, '')"
        for l in labels) + " END"


def list_sql(labels: list[str]) -> str:
    raw = "coalesce(" + ", ".join(
        f"nullif(regexp_extract(flat, '{l}\\s*[:\\-]\\s*([^.\\n]+)', 1, 'i'), '')" for l in labels) + ")"
    return (f"coalesce(array_to_string(list_slice(list_filter(list_transform(regexp_split_to_array({raw}, ',| and |/|;'), "
            "lambda x: trim(x, ' .,:;')), lambda x: x <> ''), 1, 6), '|'), '')")


def days_sql() -> str:
    return " OR ".join(
        f"coalesce(TRY_CAST(regexp_extract(flat, {re2(p)}, 2, 'i') AS BIGINT) - "
        f"TRY_CAST(regexp_extract(flat, {re2(p)}, 1, 'i') AS BIGINT) >= 10, false)" for p in tx.DAYS_RISE)


EXTRA = {
    "supplier_concentration_high": f" OR coalesce({percent_sql('top supplier')} >= 50, false)",
    "customer_concentration_high": f" OR coalesce({percent_sql('top customer')} >= 40, false)",
    "receivables_stretched": f" OR {days_sql()}",
}
SUPPLY = f"""flat AS (SELECT doc_id, applicant_id, fiscal_year, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM filings),
low AS (SELECT *, lower(flat) AS low FROM flat),
feats AS (SELECT doc_id, applicant_id, fiscal_year, {entity_sql(fv.SUPPLIER_LABELS)} AS major_supplier,
  {entity_sql(fv.BUYER_LABELS)} AS major_buyer, {list_sql(fv.PRODUCT_LABELS)} AS major_products,
  {list_sql(fv.MATERIAL_LABELS)} AS principal_raw_materials,
  {", ".join(f"({keyword_sql(w)}{EXTRA.get(n, '')}) AS {n}" for n, w in fv.SUPPLY_KEYWORDS.items())} FROM low)"""
POINTS = lambda pairs: " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in pairs)
BAND = lambda c: f"CASE WHEN {c} <= 20 THEN 'Low' WHEN {c} <= 40 THEN 'Moderate' ELSE 'High' END"
SCORES = f"""sc AS (SELECT *, {POINTS([("commodity_exposure", 20), ("weather_exposure OR import_dependency", 20),
  ("supplier_concentration_high", 20)])} AS s, {POINTS([("customer_concentration_high", 25), ("buyer_payment_risk", 20),
  ("receivables_stretched", 15), ("buyer_type_is_weak_or_unorganized", 10)])} AS b FROM feats),
scored AS (SELECT *, least(100, greatest(s, b) + CASE WHEN s > 20 AND b > 20 THEN 10 ELSE 0 END) AS o FROM sc)"""


@query("supply_features", f"""{WITH}, {SUPPLY}
SELECT *, major_supplier IS NOT NULL AS supplier_identified, major_buyer IS NOT NULL AS buyer_identified FROM feats""")
def supply_features(spark, sf_dir):
    return filings.supply_features(documents(spark, sf_dir)).withColumns({
        "major_products": F.array_join("major_products", "|"),
        "principal_raw_materials": F.array_join("principal_raw_materials", "|")})


SCORE_COLUMNS = [
    "doc_id", "supplier_risk_score", "supplier_risk_band", "buyer_risk_score", "buyer_risk_band",
    "overall_supply_chain_risk_score", "overall_supply_chain_risk_band", "weakest_link"]


@query("supply_scores", f"""{WITH}, {SUPPLY}, {SCORES}
SELECT doc_id, s AS supplier_risk_score, {BAND("s")} AS supplier_risk_band, b AS buyer_risk_score,
  {BAND("b")} AS buyer_risk_band, o AS overall_supply_chain_risk_score, {BAND("o")} AS overall_supply_chain_risk_band,
  CASE WHEN b > s THEN 'Buyer concentration and payment reliability' WHEN s > b THEN 'Input/supplier-side dependence'
    ELSE 'Both upstream and downstream dependencies' END AS weakest_link FROM scored""")
def supply_scores(spark, sf_dir):
    return filings.supply_scores(filings.supply_features(documents(spark, sf_dir))).select(*SCORE_COLUMNS)


REASONS = ", ".join(f"CASE WHEN {flag} THEN '{reason}' END" for flag, reason in fv.SUPPLY_REASONS)


@query("supply_narrative", f"""{WITH}, {SUPPLY}, {SCORES},
r AS (SELECT *, list_filter([{REASONS}], lambda x: x IS NOT NULL) AS rs FROM scored)
SELECT doc_id, coalesce(nullif(array_to_string(rs, '; '), ''), '{fv.NO_SUPPLY_REASON}') AS reasons,
  'Supply Chain Risk: ' || {BAND("o")} || ' -- Weakest link is ' || CASE WHEN b > s
    THEN 'Buyer concentration and payment reliability' WHEN s > b THEN 'Input/supplier-side dependence'
    ELSE 'Both upstream and downstream dependencies' END || '.' AS dashboard_summary,
  (CASE WHEN major_supplier IS NULL THEN 1 ELSE 0 END) + (CASE WHEN major_buyer IS NULL THEN 1 ELSE 0 END) AS notes FROM r""")
def supply_narrative(spark, sf_dir):
    told = filings.supply_narrative(filings.supply_scores(filings.supply_features(documents(spark, sf_dir))))
    return told.select("doc_id", F.array_join("reasons", "; ").alias("reasons"), "dashboard_summary",
                       F.size("confidence_notes").alias("notes"))


@query("keyword_any", f"""WITH {DOCS.cte}, low AS (SELECT doc_id, lower(text) AS low FROM docs)
SELECT doc_id, {keyword_sql(["worthless", "stupid", "of the", "that the"])} AS present FROM low""")
def keyword_any(spark, sf_dir):
    words = ["worthless", "stupid", "of the", "that the"]
    return DOCS.frame(spark, sf_dir).select("doc_id", tx.contains_any(F.lower("text"), words).alias("present"))


FLAT = f"""{WITH}, flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM filings)"""


def flat_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.trim(tx.collapse_space(F.col("text"))).alias("flat"))


@query("percent_near", f"{FLAT} SELECT doc_id, {percent_sql('top customer')} AS pct, {percent_sql('which pledged')} AS pledged FROM flat")
def percent_near(spark, sf_dir):
    flat = flat_text(spark, sf_dir)
    return flat.select("doc_id", tx.percent_near(F.col("flat"), "top customer").alias("pct"),
                       tx.percent_near(F.col("flat"), "which pledged").alias("pledged"))


@query("days_jump", f"{FLAT} SELECT doc_id, ({days_sql()}) AS jumped FROM flat")
def days_jump(spark, sf_dir):
    return flat_text(spark, sf_dir).select("doc_id", tx.days_jump(F.col("flat")).alias("jumped"))


@query("label_entities", f"""{FLAT} SELECT doc_id, {entity_sql(fv.SUPPLIER_LABELS)} AS supplier,
  {entity_sql(["facilities rated crisil", "working capital"])} AS other FROM flat""")
def label_entities(spark, sf_dir):
    return flat_text(spark, sf_dir).select(
        "doc_id", tx.label_entity(F.col("flat"), fv.SUPPLIER_LABELS).alias("supplier"),
        tx.label_entity(F.col("flat"), ["facilities rated crisil", "working capital"]).alias("other"))


@query("label_lists", f"""{FLAT} SELECT doc_id, {list_sql(fv.PRODUCT_LABELS)} AS products, {list_sql(["holding", "outlook"])} AS other
FROM flat""")
def label_lists(spark, sf_dir):
    flat = flat_text(spark, sf_dir)
    return flat.select(
        "doc_id", F.array_join(tx.label_list(F.col("flat"), fv.PRODUCT_LABELS), "|").alias("products"),
        F.array_join(tx.label_list(F.col("flat"), ["holding", "outlook"]), "|").alias("other"))
