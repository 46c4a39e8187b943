"""Pricing queries over triggers drawn from the order stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.operators import decision
from lendgrain.plans.bindings import View, figures, auditors, AUDITORS_SQL, FIGURES_SQL
from lendgrain.operators import financials
from lendgrain.plans.registry import query

# Every order raises one rule for its customer: ids run past the defined ones.
RAISED = View("raised", "orders", (
    "o_custkey AS applicant_id",
    "'P-' || lpad(CAST(o_orderkey % 36 + 1 AS STRING), 2, '0') AS rule_id",
    "CASE o_orderstatus WHEN 'F' THEN 'site' WHEN 'O' THEN 'bank' ELSE 'registry' END AS source",
    "CAST(o_orderkey AS BIGINT) AS source_ord",
))
# Per-customer signals for the threshold triggers.
SIGNALS = View("signals_raw", "orders", (
    "o_custkey AS applicant_id", "CAST(round(o_totalprice * 100) AS BIGINT) AS cents", "o_orderstatus AS st",
    "o_orderpriority AS pr"))
SIGNAL_SQL = SIGNALS.cte + """, signals AS (SELECT applicant_id, CAST(sum(cents) % 30 AS DOUBLE) AS mismatch_pct,
  sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) % 4 = 0 AS caro_default_found,
  sum(CASE WHEN st = 'O' THEN 1 ELSE 0 END) % 5 = 0 AS adverse_opinion_found,
  sum(CASE WHEN st = 'P' THEN 1 ELSE 0 END) % 4 = 0 AS emphasis_of_matter_found,
  count(*) % 3 = 0 AS restatements_detected, count(*) % 4 = 1 AS auditor_changed,
  sum(CASE WHEN pr = '1-URGENT' THEN 1 ELSE 0 END) % 3 = 0 AS adverse_media_detected
  FROM signals_raw GROUP BY applicant_id)"""

RULE_ROWS = ", ".join(
    "('{}', '{}', {}, {}, {}, {}, '{}')".format(
        r[0], r[1].replace("'", "''"), r[2], r[3], "true" if r[4] else "false", f"'{r[5]}'" if r[5] else "NULL::VARCHAR",
        r[6].replace("'", "''"))
    for r in fv.RULES)
RULES_SQL = f"rules(rule_id, name, bps, cut, manual, severity, trig) AS (VALUES {RULE_ROWS})"
WITH_TRIGGERS = f"""WITH {RAISED.cte}, {RULES_SQL},
trig AS (SELECT applicant_id, rule_id, arg_min(source, source_ord) AS source, min(source_ord) AS source_ord
  FROM raised GROUP BY applicant_id, rule_id)"""
EXACT = "CAST(round(CAST(CAST({} AS VARCHAR) AS DECIMAL(38, 20)), {}) AS DOUBLE)"


def raised(spark, sf_dir) -> DataFrame:
    return RAISED.frame(spark, sf_dir)


def triggers(spark, sf_dir) -> DataFrame:
    return decision.union_triggers(raised(spark, sf_dir))


def signals(spark, sf_dir) -> DataFrame:
    def even(name, value, n, rest=0):
        return (F.count_if(F.col(name) == value) % n == rest)
    return SIGNALS.frame(spark, sf_dir).groupBy("applicant_id").agg(
        (F.sum("cents") % 30).cast("double").alias("mismatch_pct"),
        even("st", "F", 4).alias("caro_default_found"), even("st", "O", 5).alias("adverse_opinion_found"),
        even("st", "P", 4).alias("emphasis_of_matter_found"),
        (F.count(F.lit(1)) % 3 == 0).alias("restatements_detected"), (F.count(F.lit(1)) % 4 == 1).alias("auditor_changed"),
        even("pr", "1-URGENT", 3).alias("adverse_media_detected"))


@query("union_triggers", f"{WITH_TRIGGERS} SELECT * FROM trig")
def union_triggers(spark, sf_dir):
    return triggers(spark, sf_dir)


@query("derived_triggers", f"""WITH {SIGNAL_SQL},
d AS (SELECT applicant_id, 'P-01' AS rule_id, 'gst' AS source, 100 AS source_ord FROM signals WHERE mismatch_pct > 15
 UNION ALL SELECT applicant_id, 'P-03', 'audit', 200 FROM signals WHERE caro_default_found OR adverse_opinion_found
 UNION ALL SELECT applicant_id, 'P-04', 'audit', 201 FROM signals WHERE emphasis_of_matter_found
 UNION ALL SELECT applicant_id, 'P-09', 'restatement', 300 FROM signals WHERE restatements_detected
 UNION ALL SELECT applicant_id, 'P-10', 'restatement', 301 FROM signals WHERE auditor_changed
 UNION ALL SELECT applicant_id, 'P-13', 'news', 400 FROM signals WHERE adverse_media_detected
 UNION ALL SELECT applicant_id, 'P-14', 'registry', 500 FROM signals WHERE mismatch_pct > 27
 UNION ALL SELECT applicant_id, 'P-27', 'registry', 501 FROM signals WHERE mismatch_pct > 27)
SELECT * FROM d""")
def derived_triggers(spark, sf_dir):
    s = signals(spark, sf_dir)
    listed = s.filter("mismatch_pct > 27").select(
        "applicant_id", F.array(F.lit("P-14"), F.lit("P-27")).alias("triggered_rules"))
    return decision.derive_triggers(gst=s, audit=s, restated=s, news=s, listed=[("registry", listed, "triggered_rules")])


@query("applied_penalties", f"""{WITH_TRIGGERS}
SELECT t.applicant_id, t.rule_id, t.source, t.source_ord, r.name, r.bps AS rate_penalty_bps, r.cut AS limit_reduction_pct,
  r.manual AS requires_manual_review, r.severity, r.trig AS trigger FROM trig t JOIN rules r USING (rule_id)""")
def applied_penalties(spark, sf_dir):
    return decision.apply_rules(triggers(spark, sf_dir), decision.rule_table(spark))


DECIDE_SQL = f"""folded AS (SELECT applicant_id, coalesce(sum(bps), 0) AS bps,
  list_reduce(list_prepend(CAST(10 AS DOUBLE), list(1 - cut / CAST(100 AS DOUBLE) ORDER BY source_ord, rule_id)
    FILTER (WHERE cut IS NOT NULL)), lambda a, b: a * b) AS lim,
  list_reduce(list_prepend(CAST(9 AS DOUBLE), list(bps / CAST(100 AS DOUBLE) ORDER BY source_ord, rule_id)
    FILTER (WHERE cut IS NOT NULL)), lambda a, b: a + b) AS rate,
  coalesce(bool_or(manual), false) AS manual, count(*) AS n, count(bps) AS priced,
  string_agg(rule_id, ',' ORDER BY source_ord, rule_id) AS ids
  FROM (SELECT t.*, r.bps, r.cut, r.manual FROM chosen t LEFT JOIN rules r USING (rule_id)) GROUP BY applicant_id)
SELECT a.applicant_id, {EXACT.format("coalesce(rate, 9.0)", 2)} AS final_rate_pct,
  {EXACT.format("coalesce(lim, 10.0)", 2)} AS final_limit_cr,
  CASE WHEN manual THEN 'MANUAL_REVIEW' WHEN n > 0 THEN 'CONDITIONAL_APPROVAL' ELSE 'APPROVE' END AS recommendation,
  coalesce(manual, false) AS requires_manual_review, coalesce(n, 0) AS rules_triggered,
  coalesce(priced, 0) AS penalties_applied, CAST(coalesce(bps, 0) AS BIGINT) AS total_bps,
  coalesce(ids, '') AS triggered_rules
FROM (SELECT c_custkey AS applicant_id FROM customer) a LEFT JOIN folded USING (applicant_id)"""


def _applicants(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("applicant_id"))


def decisions(spark, sf_dir, sources=None):
    return decision.decide(
        triggers(spark, sf_dir), decision.rule_table(spark), _applicants(spark, sf_dir), sources=sources)


@query("decisions", f"{WITH_TRIGGERS}, chosen AS (SELECT * FROM trig), {DECIDE_SQL}")
def all_decisions(spark, sf_dir):
    return decisions(spark, sf_dir).withColumn("triggered_rules", F.array_join("triggered_rules", ","))


@query("decisions_of_sources",
       f"{WITH_TRIGGERS}, chosen AS (SELECT * FROM trig WHERE source IN ('site', 'registry')), {DECIDE_SQL}")
def decisions_of_sources(spark, sf_dir):
    return decisions(spark, sf_dir, ["site", "registry"]).withColumn(
        "triggered_rules", F.array_join("triggered_rules", ","))


@query("decision_waterfall", f"""{WITH_TRIGGERS},
s AS (SELECT applicant_id, 1 + row_number() OVER w AS step, rule_id, name, trig AS finding, bps AS rate_penalty_bps,
  cut AS limit_reduction_pct, list(bps / CAST(100 AS DOUBLE)) OVER w AS adds, list(1 - cut / CAST(100 AS DOUBLE)) OVER w AS keeps
  FROM trig JOIN rules USING (rule_id)
  WINDOW w AS (PARTITION BY applicant_id ORDER BY source_ord, rule_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT applicant_id, CAST(step AS INTEGER) AS step, rule_id, name, finding, rate_penalty_bps, limit_reduction_pct,
  list_reduce(list_prepend(CAST(9 AS DOUBLE), adds), lambda a, b: a + b) AS running_rate,
  list_reduce(list_prepend(CAST(10 AS DOUBLE), keeps), lambda a, b: a * b) AS running_limit FROM s)
SELECT *, name || ' — ' || finding || ' → ' || coalesce(nullif(concat_ws('; ',
  CASE WHEN rate_penalty_bps > 0 THEN printf('+%d bps to rate (now %.1f%%)', rate_penalty_bps, {EXACT.format("running_rate", 1)}) END,
  CASE WHEN limit_reduction_pct > 0 THEN printf('−%d%% limit cut (now ₹%.2f Cr)', limit_reduction_pct,
    {EXACT.format("running_limit", 2)}) END), ''), 'no auto-penalty') || '.' AS description FROM r""")
def decision_waterfall(spark, sf_dir):
    return decision.waterfall(triggers(spark, sf_dir), decision.rule_table(spark))


@query("decision_narrative", f"""{WITH_TRIGGERS},
s AS (SELECT applicant_id, 1 + row_number() OVER w AS step, name, trig AS finding, bps, cut,
  9.0 + sum(bps) OVER w / CAST(100 AS DOUBLE) AS rate
  FROM trig JOIN rules USING (rule_id)
  WINDOW w AS (PARTITION BY applicant_id ORDER BY source_ord, rule_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT a.applicant_id, 2 + count(s.step) AS lines,
  coalesce(string_agg(s.name || ' — ' || s.finding, '; ' ORDER BY s.step) FILTER (WHERE s.step <= 4), '') AS opening
  FROM (SELECT c_custkey AS applicant_id FROM customer) a LEFT JOIN s USING (applicant_id) GROUP BY 1)
SELECT applicant_id, lines, opening FROM n""")
def decision_narrative(spark, sf_dir):
    steps = decision.waterfall(triggers(spark, sf_dir), decision.rule_table(spark))
    told = decision.narrative(steps, decisions(spark, sf_dir))
    opening = F.regexp_extract("rationale", r"(?s)triggered\. (.*)\. Final rate: ", 1)
    return told.select("applicant_id", F.size(F.split("narrative", "\n", -1)).cast("bigint").alias("lines"),
                       opening.alias("opening"))


@query("penalty_totals", f"""{WITH_TRIGGERS}
SELECT applicant_id, count(*) AS penalties, CAST(sum(bps) AS BIGINT) AS total_bps, CAST(sum(cut) AS BIGINT) AS total_cut_pct
FROM trig JOIN rules USING (rule_id) GROUP BY applicant_id""")
def penalty_totals(spark, sf_dir):
    return decision.penalty_totals(triggers(spark, sf_dir), decision.rule_table(spark))


@query("risk_matrix", f"""{WITH_TRIGGERS}
SELECT applicant_id, CAST(row_number() OVER (PARTITION BY applicant_id ORDER BY source_ord, rule_id) AS INTEGER) AS line,
  rule_id, name, trig AS trigger, bps AS rate_penalty_bps, cut AS limit_reduction_pct,
  CASE WHEN rule_id = 'P-09' THEN 'CRITICAL' WHEN cut > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS memo_severity
FROM trig JOIN rules USING (rule_id)""")
def risk_matrix(spark, sf_dir):
    return decision.risk_matrix(triggers(spark, sf_dir), decision.rule_table(spark))


CONDITION_ROWS = ", ".join("({}, '{}', '{}')".format(n, r, c) for n, (r, c) in enumerate(fv.RULE_CONDITIONS))
STANDING_ROWS = ", ".join(
    "({}, '{}')".format(n + len(fv.RULE_CONDITIONS), c) for n, c in enumerate(fv.STANDING_CONDITIONS))


@query("conditions_precedent", f"""{WITH_TRIGGERS},
mapped(ord, rule_id, condition) AS (VALUES {CONDITION_ROWS}), standing(ord, condition) AS (VALUES {STANDING_ROWS}),
c AS (SELECT applicant_id, ord, condition FROM trig JOIN mapped USING (rule_id)
  UNION ALL SELECT c_custkey, ord, condition FROM customer CROSS JOIN standing)
SELECT applicant_id, CAST(row_number() OVER (PARTITION BY applicant_id ORDER BY ord) AS INTEGER) AS line, condition
FROM c""")
def conditions_precedent(spark, sf_dir):
    return decision.conditions(triggers(spark, sf_dir), _applicants(spark, sf_dir))


# --- Multi-year figures --------------------------------------------------------------
FIG = f"WITH {FIGURES_SQL}, scans AS (SELECT applicant_id, fiscal_year, row_number() OVER " \
      "(PARTITION BY applicant_id ORDER BY fiscal_year) AS scan FROM (SELECT DISTINCT applicant_id, fiscal_year FROM figures))"
RESTATED_SQL = f"""{FIG}, r AS (SELECT f.*, s.scan FROM figures f JOIN scans s USING (applicant_id, fiscal_year)),
ch AS (SELECT c.applicant_id, c.figure, p.fiscal_year AS year_restated, c.fiscal_year AS restated_in,
  p.value AS original_value, c.previous_value AS restated_value,
  (c.previous_value - p.value) / abs(p.value) * 100 AS change
  FROM r c JOIN r p ON c.applicant_id = p.applicant_id AND c.figure = p.figure AND c.scan = p.scan + 1
  WHERE c.previous_value IS NOT NULL AND p.value <> 0)"""


@query("restatements", f"""{RESTATED_SQL}
SELECT applicant_id, figure, CAST(list_position(['Revenue','EBITDA','PAT','Total Debt','Net Worth'], figure) AS INTEGER)
  AS figure_ord, year_restated, restated_in, original_value, restated_value,
  {EXACT.format("change", 1)} AS change_pct, CASE WHEN abs(change) > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN change < 0 THEN 'downward' ELSE 'upward' END AS direction
FROM ch WHERE abs(change) > 2""")
def restatements(spark, sf_dir):
    return financials.restatements(figures(spark, sf_dir))


@query("yoy_trend", f"""{FIG}, b AS (SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY scan DESC) AS back
  FROM scans), p AS (SELECT f.applicant_id, f.figure, max(CASE WHEN back = 2 THEN value END) AS old_value,
  max(CASE WHEN back = 1 THEN value END) AS new_value FROM figures f JOIN b USING (applicant_id, fiscal_year)
  WHERE back <= 2 AND figure IN ('Revenue', 'PAT', 'Net Worth') GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN old_value <> 0 THEN (new_value - old_value) / abs(old_value) * 100 END AS change FROM p
  WHERE applicant_id IN (SELECT applicant_id FROM b WHERE back = 2))
SELECT applicant_id, figure, old_value, new_value, round(change, 4) AS change_pct,
  CASE WHEN change > 5 THEN 'improving' WHEN change < -5 THEN 'deteriorating' WHEN change IS NOT NULL THEN 'stable' END
  AS direction FROM c""")
def yoy_trend(spark, sf_dir):
    return financials.yoy_trend(figures(spark, sf_dir))


@query("financial_ratios", f"""{FIG}, w AS (SELECT applicant_id, fiscal_year,
  max(CASE WHEN figure = 'Revenue' THEN value END) AS rev, max(CASE WHEN figure = 'Revenue' THEN previous_value END) AS prv,
  max(CASE WHEN figure = 'EBITDA' THEN value END) AS ebitda, max(CASE WHEN figure = 'Total Debt' THEN value END) AS debt,
  max(CASE WHEN figure = 'Net Worth' THEN value END) AS net_worth FROM figures GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN rev >= 50000 THEN rev ELSE prv END AS revenue FROM w)
SELECT applicant_id, fiscal_year, revenue, CASE WHEN rev >= 50000 THEN prv END AS previous_revenue, ebitda, debt, net_worth,
  round(CASE WHEN net_worth <> 0 AND debt <> 0 THEN debt / net_worth END, 6) AS debt_equity,
  round(CASE WHEN ebitda <> 0 AND revenue > 0 THEN ebitda / revenue * 100 END, 6) AS ebitda_margin_pct FROM r""")
def financial_ratios(spark, sf_dir):
    return financials.ratios(figures(spark, sf_dir), 50_000.0).withColumns({
        "debt_equity": F.round("debt_equity", 6), "ebitda_margin_pct": F.round("ebitda_margin_pct", 6)})


@query("auditor_history", f"""WITH {AUDITORS_SQL}
SELECT applicant_id, count(DISTINCT auditor) > 1 AS auditor_changed,
  string_agg(auditor, '|' ORDER BY fiscal_year) AS auditors, arg_max(auditor, fiscal_year) AS latest_auditor
FROM auditors WHERE auditor <> '' GROUP BY applicant_id""")
def auditor_history(spark, sf_dir):
    return financials.auditor_history(auditors(spark, sf_dir)).withColumn("auditors", F.array_join("auditors", "|"))


@query("auditor_changes", f"""WITH {AUDITORS_SQL}, l AS (SELECT applicant_id, fiscal_year, auditor,
  lag(auditor) OVER (PARTITION BY applicant_id ORDER BY fiscal_year) AS previous_auditor FROM auditors WHERE auditor <> '')
SELECT applicant_id, fiscal_year, previous_auditor, auditor FROM l WHERE auditor <> previous_auditor""")
def auditor_changes(spark, sf_dir):
    return financials.auditor_changes(auditors(spark, sf_dir))


@query("restatement_flags", f"""{RESTATED_SQL}, {AUDITORS_SQL},
a AS (SELECT applicant_id, count(DISTINCT auditor) > 1 AS c FROM auditors WHERE auditor <> '' GROUP BY 1),
k AS (SELECT DISTINCT applicant_id FROM ch WHERE abs(change) > 2)
SELECT o.applicant_id, k.applicant_id IS NOT NULL AS restatements_detected, coalesce(a.c, false) AS auditor_changed
FROM (SELECT DISTINCT o_custkey AS applicant_id FROM orders) o LEFT JOIN k USING (applicant_id)
LEFT JOIN a USING (applicant_id)""")
def restatement_flags(spark, sf_dir):
    return financials.restatement_flags(figures(spark, sf_dir), auditors(spark, sf_dir))


@query("restatement_finding_texts", f"""{RESTATED_SQL}, {AUDITORS_SQL},
f AS (SELECT applicant_id, figure, year_restated, {EXACT.format("change", 1)} AS pct, row_number() OVER (
  PARTITION BY applicant_id ORDER BY year_restated,
  list_position(['Revenue','EBITDA','PAT','Total Debt','Net Worth'], figure)) AS rn FROM ch WHERE abs(change) > 2)
SELECT applicant_id, 'P-09' AS rule_id, figure || ' restated by ' || pct || '% in ' || year_restated || ' comparative'
  AS finding FROM f WHERE rn = 1
UNION ALL SELECT applicant_id, 'P-10', 'auditor changed across reporting periods (history: ' ||
  string_agg(auditor, ', ' ORDER BY fiscal_year) || ')' FROM auditors WHERE auditor <> '' GROUP BY applicant_id
  HAVING count(DISTINCT auditor) > 1""")
def restatement_finding_texts(spark, sf_dir):
    f, a = figures(spark, sf_dir), auditors(spark, sf_dir)
    return decision.restatement_findings(financials.restatements(f), financials.auditor_history(a))


UPLOADS = View("uploads", "orders", (
    "o_custkey AS applicant_id",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'notes' WHEN o_orderkey % 7 = 0 THEN 'file' ELSE 'file_fy' || "
    "CAST(year(o_orderdate) % 100 AS STRING) END AS field",
    "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'report_' || CAST(o_custkey AS STRING) || '_' || "
    "CAST(year(o_orderdate) AS STRING) || '.pdf' END AS file_name"))


@query("latest_year", f"""WITH {UPLOADS.cte}, l AS (SELECT applicant_id, file_name,
  CASE WHEN field LIKE '%!_%' ESCAPE '!' THEN upper(split_part(field, '_', 2)) ELSE 'LATEST' END AS y FROM uploads
  WHERE field LIKE 'file%' AND file_name <> '')
SELECT applicant_id, max(y) AS latest_year, count(DISTINCT y) AS years, max({{'y': y, 'f': file_name}}).f AS file_name
FROM l GROUP BY applicant_id""")
def latest_year(spark, sf_dir):
    return financials.latest_year(UPLOADS.frame(spark, sf_dir))


CANDIDATES = View("candidates", "lineitem", (
    "l_orderkey", "l_linenumber", "l_suppkey", "CAST(round(l_quantity) AS BIGINT) AS score"))


@query("best_per_group", f"""WITH {CANDIDATES.cte}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY score DESC, l_linenumber, l_suppkey) AS rn FROM candidates)
SELECT l_orderkey, l_linenumber, l_suppkey, score FROM r WHERE rn = 1""")
def best_per_group(spark, sf_dir):
    return financials.best_per_group(
        CANDIDATES.frame(spark, sf_dir), ["l_orderkey"], "score", ["l_linenumber", "l_suppkey"])
