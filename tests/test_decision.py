from __future__ import annotations

import random

from pyspark.sql import functions as F

from lendgrain.operators import base_terms, decision, network, verify
from lendgrain.plans import verify_queries as vq
from lendgrain.plans import portfolio


def triggers(spark, cases):
    rows = [(a, r, "s", n) for a, rules in cases.items() for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "applicant_id long, rule_id string, source string, source_ord int")


CASES = {1: ["P-01"], 2: ["P-03", "P-06"], 3: ["P-14"], 4: ["P-34"], 5: ["P-28", "P-29"]}


def test_golden_decisions(spark):
    applicants = spark.createDataFrame([(n,) for n in range(6)], "applicant_id long")
    out = {r.applicant_id: r for r in decision.decide(
        triggers(spark, CASES), decision.rule_table(spark), applicants).collect()}
    got = {a: (r.final_rate_pct, r.final_limit_cr, r.recommendation) for a, r in out.items()}
    assert got == {
        0: (9.0, 10.0, "APPROVE"), 1: (10.0, 9.0, "CONDITIONAL_APPROVAL"), 2: (12.5, 5.6, "MANUAL_REVIEW"),
        3: (9.0, 0.0, "MANUAL_REVIEW"), 4: (9.0, 10.0, "CONDITIONAL_APPROVAL"), 5: (11.0, 6.75, "CONDITIONAL_APPROVAL")}
    assert out[2].triggered_rules == ["P-03", "P-06"]


def test_more_rules_never_price_lower(spark):
    ids = [f"P-{n:02d}" for n in range(1, 34)]
    out = decision.decide(
        triggers(spark, {n: ids[:n] for n in range(1, 34)}), decision.rule_table(spark)).orderBy("applicant_id").collect()
    for a, b in zip(out, out[1:]):
        assert b.final_rate_pct >= a.final_rate_pct and b.final_limit_cr <= a.final_limit_cr


def test_waterfall_text(spark):
    steps = decision.waterfall(triggers(spark, {1: ["P-01", "P-04"]}), decision.rule_table(spark)).orderBy("step").collect()
    assert steps[0].description == (
        "Ghost Input Trap — GSTR-2A vs 3B mismatch > 15% (Perfios) → +100 bps to rate (now 10.0%); "
        "−10% limit cut (now ₹9.00 Cr).")
    assert steps[1].description.endswith("→ +75 bps to rate (now 10.8%).") and steps[1].step == 3


def test_narrative_frames_the_steps(spark):
    applicants = spark.createDataFrame([(1,), (2,)], "applicant_id long")
    t, rules = triggers(spark, {1: ["P-01"]}), decision.rule_table(spark)
    told = {r.applicant_id: r for r in decision.narrative(
        decision.waterfall(t, rules), decision.decide(t, rules, applicants)).collect()}
    lines = told[1].narrative.split("\n")
    assert lines[0].startswith("Step 1: Base rate set at 9.0%") and lines[1].startswith("Step 2: Ghost Input Trap")
    assert lines[2] == "Final Decision: Rate 10.0% | Limit ₹9.0 Cr | CONDITIONAL_APPROVAL"
    assert told[2].rationale.startswith("APPROVE — No risk signals")


def test_check_texts(spark):
    claims = spark.createDataFrame(
        [(1, "revenue", "c", 10.0), (2, "revenue", "c", 10.0)], "applicant_id long, claim_id string, claim_text string, num_value double")
    bank = spark.createDataFrame([(1, 75_000_000.0), (2, 9.5e7)], "applicant_id long, total_credits double")
    rows = {r.applicant_id: r for r in verify.check_revenue(claims, bank).collect()}
    assert rows[1].finding == "Bank deposits: 7.5 Cr (75% of claimed revenue)" and rows[1].status == "PARTIAL_MATCH"
    assert rows[2].status == "MATCH"


def test_worst_status_and_rules(spark):
    rows = [(1, "revenue", "t", "MATCH", "INFO"), (1, "revenue", "t", "MISMATCH", "HIGH"), (1, "credit_rating", "t", "PARTIAL_MATCH", "MEDIUM"),
            (1, "gst_bank_reconciliation", "t", "MISMATCH", "HIGH")]
    rolled = verify.roll_up(spark.createDataFrame(
        rows, "applicant_id long, claim_id string, claim_text string, status string, severity string"))
    assert verify.verification_rules(rolled).first().triggered_rules == ["P-31", "P-33"]
    assert [r.claim_id for r in verify.contradicted(rolled).collect()] == ["revenue"]


def test_shared_attribute_yields_a_star_not_all_pairs(spark):
    rows = [(1, "applicant" if n == 3 else "counterparty", f"E{n}", ["A Rao"], None) for n in range(50)]
    flags = network.relationship_flags(spark.createDataFrame(
        rows, "applicant_id long, role string, entity string, directors array<string>, address string"))
    got = flags.filter("flag_type = 'shared_director'").collect()
    assert len(got) == 49 and {r.entity_a for r in got} == {"E3"}


def test_loops_through_the_applicant(spark):
    edges = spark.createDataFrame(
        [(1, "A", "V", 5.0), (1, "V", "N", 4.8), (1, "N", "A", 4.5), (1, "V", "A", 1.0), (1, "N", "V", 9.0)],
        "applicant_id long, src string, dst string, value double")
    loops = network.circular_loops(edges, spark.createDataFrame([(1, "A")], "applicant_id long, node string"))
    assert sorted((r.path, r.loop_value, r.through_applicant) for r in loops.collect()) == [
        (["A", "V"], 1.0, True), (["A", "V", "N"], 4.5, True), (["N", "V"], 4.8, False)]


def all_loops(paid, anchor):
    """Loops of two and three nodes by trying every walk; a node pays itself nothing."""
    found = {}
    ahead = {}
    for (a, b), value in paid.items():
        if a != b:
            ahead.setdefault(a, {})[b] = value
    for a in ahead:
        for b, ab in ahead[a].items():
            walks = [((a, b), (ab, ahead.get(b, {}).get(a)))]
            walks += [((a, b, c), (ab, bc, ahead.get(c, {}).get(a))) for c, bc in ahead.get(b, {}).items() if c != a]
            for path, values in walks:
                if None not in values:
                    first = path.index(anchor) if anchor in path else path.index(min(path))
                    found[path[first:] + path[:first]] = (min(values), anchor in path)
    return found


def test_loops_among_counterparties_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(g, f"n{r.randrange(12)}", f"n{r.randrange(12)}", float(r.randrange(1, 99))) for g in (1, 2, 3) for _ in range(25 * g)]
    rows += [(4, "hub", f"s{i}", 1.0) for i in range(30)] + [(4, f"s{i}", "hub", 2.0) for i in range(0, 30, 2)]
    rows += [(4, f"s{i}", f"s{i + 1}", 3.0) for i in range(29)]
    want = {}
    for g, anchor in ((1, "n0"), (2, "n1"), (3, None), (4, "s3")):
        paid = {}
        for _, a, b, value in (x for x in rows if x[0] == g):
            paid[a, b] = paid.get((a, b), 0) + value
        want |= {(g, path): found for path, found in all_loops(paid, anchor).items()}
    edges = spark.createDataFrame(rows, "applicant_id long, src string, dst string, value double")
    anchors = spark.createDataFrame([(1, "n0"), (2, "n1"), (4, "s3")], "applicant_id long, node string")
    got = network.circular_loops(edges, anchors).collect()
    assert {(x.applicant_id, tuple(x.path)): (x.loop_value, x.through_applicant) for x in got} == want and len(got) == len(want)


def test_a_hub_of_many_links_forms_no_pairs(spark):
    spokes = spark.range(100_000).select(F.lit(1).cast("long").alias("applicant_id"), F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    some = spark.range(0, 100_000, 1000)
    edges = spokes.unionByName(some.selectExpr("1L AS applicant_id", "id AS src", "id + 1 AS dst")).unionByName(
        some.selectExpr("1L AS applicant_id", "id + 1 AS src", "-1L AS dst")).withColumn("value", F.lit(1.0))
    loops = network.circular_loops(edges, spark.createDataFrame([(1, -1)], "applicant_id long, node long"))
    assert {tuple(r) for r in loops.groupBy("length", "through_applicant").count().collect()} == {(2, True, 100), (3, True, 100)}


def test_nested_result(spark):
    t, rules = triggers(spark, {1: ["P-01", "P-03"]}), decision.rule_table(spark)
    out = portfolio.assemble_result(
        decision.decide(t, rules), {}, {"penalties": (decision.apply_rules(t, rules).select(
            "applicant_id", "source_ord", "rule_id"), ["source_ord"])}).first()
    assert [p.rule_id for p in out.penalties] == ["P-01", "P-03"]


def test_model_learns_a_step(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("applicant_id"), (F.col("id") % 40 / 10.0).alias("dscr")).withColumns({
            "base_rate": F.when(F.col("dscr") < 1, 12.0).otherwise(9.0), "base_limit": F.lit(5.0)})
    model = base_terms.fit_base_terms(rows, trees=5, depth=3)
    model.write().overwrite().save(str(tmp_path / "model"))
    out = base_terms.predict_base_terms(model, rows.select("applicant_id", "dscr"))
    worst = out.join(rows.select("applicant_id", "base_rate"), "applicant_id").agg(
        F.max(F.abs(F.col("ml_base_rate_pct") - F.col("base_rate")))).first()[0]
    assert worst < 0.5
    assert base_terms.predict_base_terms(None, rows.select("applicant_id")).first().model_status == "fallback_no_model"


def test_screening_is_the_same_with_and_without_broadcast(spark):
    names = [(n, "FY1", a) for n, a in enumerate(["Rao & Co LLP", "RAO", "M/s Gupta Sharma & Associates", "K", "", None, "Zed", "Rajesh Kumar & Co"])]
    auditors = spark.createDataFrame(names, "applicant_id long, fiscal_year string, auditor string")
    lists = spark.createDataFrame(
        [("BLACKLISTED", "Gupta Sharma & Associates", "HIGH", ""), ("WATCHLIST", "Rao & Co", "INFO", ""), ("BLACKLISTED", "ED", "LOW", ""),
         ("WATCHLIST", "Kay", "LOW", "")], "list_type string, firm string, severity string, reason string")
    rows = [sorted(map(str, network.screen_auditors(auditors, lists, most).collect())) for most in (100, 0)]
    assert rows[0] == rows[1]
    status = {r.applicant_id: r.status for r in network.screen_auditors(auditors, lists).collect()}
    assert status == {0: "WATCHLIST", 1: "WATCHLIST", 2: "BLACKLISTED", 3: "WATCHLIST", 4: "NOT_CHECKED", 5: "NOT_CHECKED",
                      6: "BLACKLISTED", 7: "CLEAR"}


def test_screening_ignores_blank_and_repeated_list_entries(spark):
    auditors = spark.createDataFrame(
        [(n, "FY1", a) for n, a in enumerate(["Rao & Co LLP", "Kay", "Unknown Firm", "A"])], "applicant_id long, fiscal_year string, auditor string")
    lists = spark.createDataFrame(
        [("WATCHLIST", "Rao & Co", "INFO", "")] * 2 + [("BLACKLISTED", "  ", "HIGH", ""), ("BLACKLISTED", "", "HIGH", ""), ("BLACKLISTED", None, "HIGH", ""),
         ("BLACKLISTED", "Kay Brothers Chartered Accountants", "HIGH", "")], "list_type string, firm string, severity string, reason string")
    rows = [{r.applicant_id: (r.status, r.records) for r in network.screen_auditors(auditors, lists, most).collect()} for most in (100, 0)]
    assert rows[0] == rows[1] == {0: ("WATCHLIST", 1), 1: ("BLACKLISTED", 1), 2: ("CLEAR", 0), 3: ("BLACKLISTED", 2)}


def test_purpose_of_an_applicant_without_spending(spark):
    applications = spark.createDataFrame([(1, "Working capital", "textile mill")], "applicant_id long, stated_purpose string, activity string")
    row = network.loan_purpose(applications, spark.createDataFrame([], "applicant_id long, category string, pct double")).first()
    assert row.overall_status == "PARTIAL_MISMATCH" and row.flags[0].detail.startswith("Only 0.0% of outflows") and row.fund_utilization is None


def test_reconciliation_covers_applicants_without_claims(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    claims = empty("applicant_id long, claim_id string, claim_text string, num_value double, second_value double, clean boolean, "
                   "rating string, label string, confidence string")
    gst = spark.createDataFrame([(7, 3.0, 10.0, "Regular")], "applicant_id long, mismatch_pct double, turnover_cr double, filing_consistency string")
    statement = spark.createDataFrame([(7, 5, 2.0e7, 0)], "applicant_id long, total_transactions long, total_credits double, cash_spikes long")
    evidence = {
        "gst": gst, "statement": statement, "benchmark": empty("applicant_id long, sector string, deviation_pct double"),
        "bureau": empty("applicant_id long, dpd_30 long, dpd_90 long, suit_filed_cr double, credit_score long, bureau_rating string"),
        "registry": empty("applicant_id long, director_disqualified boolean, epfo_compliance string, active_litigations array<string>"),
        "news": empty("applicant_id long, adverse_media_detected boolean"), "red_flags": empty("applicant_id long, headline string, summary string"),
        "courts": empty("applicant_id long, cases_found long, high_risk_cases long"), "site": empty("applicant_id long, site_findings long")}
    checks = verify.verify(claims, evidence, gst.select("applicant_id")).collect()
    assert [(r.applicant_id, r.status) for r in checks] == [(7, "MISMATCH")]


def test_portfolio_prices_every_source(spark):
    from datetime import datetime
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    txns = make([(4, 0, datetime(2024, 1, 1), "01-01-2024", "NEFT CR-1-X-PAYER ONE--", 0.0, 2.0e7, 5.0)],
                "applicant_id long, seq long, ts timestamp_ntz, date_str string, description string, debit double, credit double, balance double")
    filings = make([(1, 11, "FY24", "Undisputed statu-\ntory dues including provident fund remain outstanding " + "x " * 80), (2, 12, "FY24", "y " * 80)],
                   "applicant_id long, doc_id long, fiscal_year string, text string")
    notes = make([(3, 31, "all fine")], "applicant_id long, note_id long, notes string")
    evidence = {
        "gst": make([(4, 3.0, 10.0, "Regular")], "applicant_id long, mismatch_pct double, turnover_cr double, filing_consistency string"),
        "benchmark": make([], "applicant_id long, sector string, deviation_pct double"),
        "bureau": make([], "applicant_id long, dpd_30 long, dpd_90 long, suit_filed_cr double, credit_score long, bureau_rating string"),
        "registry": make([(1, True, "Regular", [])], "applicant_id long, director_disqualified boolean, epfo_compliance string, active_litigations array<string>"),
        "news": make([], "applicant_id long, adverse_media_detected boolean"), "red_flags": make([], "applicant_id long, headline string, summary string"),
        "courts": make([(2, 3, 1)], "applicant_id long, cases_found long, high_risk_cases long")}
    outside = {"counterparty": make([(3, ["P-06"])], "applicant_id long, triggered_rules array<string>")}
    out = portfolio.appraise(
        txns, filings, notes, evidence, make([], "applicant_id long, fiscal_year string, figure string, value double, previous_value double"),
        make([], "applicant_id long, fiscal_year string, auditor string"), decision.rule_table(spark), None, outside)
    rules = {}
    for r in out["triggers"].collect():
        rules.setdefault(r.applicant_id, set()).add(r.rule_id)
    assert {"P-03", "P-14"} <= rules[1] and "P-15" in rules[2] and "P-06" in rules[3] and "P-33" in rules[4]
    assert {r.applicant_id: r.final_limit_cr for r in out["decisions"].collect()}[1] == 0.0


def test_kept_models_stand_beside_their_training(spark, tmp_path):
    rows = spark.range(300).select(
        F.col("id").alias("applicant_id"), (F.col("id") % 20 / 10.0).alias("dscr"), (F.col("id") % 7).cast("double").alias("leverage_ratio")).withColumns({
            "base_rate": F.when(F.col("dscr") < 1, 12.0).otherwise(9.0), "base_limit": F.when(F.col("leverage_ratio") > 3, 5.0).otherwise(10.0)})
    path = str(tmp_path)
    first = base_terms.keep_base_terms(rows, path, trees=3, depth=3)
    assert base_terms.keep_base_terms(rows.orderBy(F.desc("applicant_id")), path, trees=3, depth=3) == first  # the same rows overwrite themselves
    second = base_terms.keep_base_terms(rows.withColumn("base_rate", F.lit(8.0)), path, trees=3, depth=3)
    versions = {r.version: r for r in base_terms.kept_versions(spark, path).collect()}
    assert set(versions) == {first, second} and versions[first].rows == 300 and versions[first].rmse_base_rate < 0.01
    ratios = rows.select("applicant_id", "dscr", "leverage_ratio")
    rates = lambda model: {r.ml_base_rate_pct for r in base_terms.predict_base_terms(model, ratios).collect()}
    assert rates(base_terms.load_base_terms(spark, path)) == {8.0}
    kept, fresh = base_terms.load_base_terms(spark, path, first), base_terms.fit_base_terms(rows, trees=3, depth=3)
    score = lambda model: sorted(map(tuple, base_terms.predict_base_terms(model, ratios).collect()))
    assert score(kept) == score(fresh) and rates(kept) == {9.0, 12.0}


def test_a_status_is_read_without_findings(spark):
    """Only the number of the case is exploded: no text is written for a reader of the status."""
    t = vq.tables(spark, "/root/testdata/sf0.001")
    checks = verify.verify(vq.claims(t), t)
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Bureau data confirms" in plan(checks)
    assert "Bureau data confirms" not in plan(verify.roll_up(checks))
