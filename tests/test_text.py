from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions import spans as sp
from lendgrain.functions import text as tx
from lendgrain.operators import filings, layout, prose
from lendgrain.plans import portfolio
from lendgrain.sources import reports


def docs(spark, *texts):
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("pattern", [r"ab", r"(a+)(b?)", r"b[\s\S]{0,3}?c", r"(?iu)A(.)"])
def test_spans_equal_python(spark, pattern):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(40))) for _ in range(60)]
    groups = re.compile(pattern.replace("(?iu)", "(?i)")).groups
    rows = docs(spark, *texts).withColumn("m", sp.spans("text", pattern, groups)).collect()
    for r in rows:
        assert [tuple(m) for m in r.m] == [
            (m.start(), m.end(), m.group(0), *[g or "" for g in m.groups()])
            for m in re.finditer(pattern.replace("(?iu)", "(?i)"), r.text)]


def test_marks_inside_a_text_do_no_harm(spark):
    frame = filings.lowered(docs(spark, "A\x01B\x02AB\x03")).withColumn("m", sp.spans("_low", "ab", 0))
    assert [(m.start, m.end) for m in frame.first().m] == [(4, 6)]


def test_negation_matches_inside_words_by_default(spark):
    frame = docs(spark, "management notes commodity prices", "commodity prices", "no single supplier", "nothing. commodity")
    default = [r[0] for r in frame.orderBy("doc_id").select(tx.contains_any(F.col("text"), ["commodity", "supplier"])).collect()]
    whole = [r[0] for r in frame.orderBy("doc_id").select(
        tx.contains_any(F.col("text"), ["commodity", "supplier"], whole_word=True)).collect()]
    assert default == [False, True, False, True] and whole == [True, True, False, True]


def test_buyer_side_flags_and_scores(spark):
    frame = docs(
        spark,
        "Top 2 customers account for 70% of revenue. Trade receivables increased. Receivable days increased from 60 to 85. "
        "Delayed payments were seen from key customers. Sales are via small buyers and local traders.",
        "Calm year.")
    rows = filings.supply_narrative(filings.supply_scores(filings.supply_features(frame))).orderBy("doc_id").collect()
    assert rows[0].customer_concentration_high and rows[0].buyer_payment_risk and rows[0].receivables_stretched
    assert rows[0].buyer_type_is_weak_or_unorganized
    assert (rows[0].supplier_risk_score, rows[0].buyer_risk_score, rows[0].overall_supply_chain_risk_score) == (0, 70, 70)
    assert rows[0].weakest_link == "Buyer concentration and payment reliability"
    assert rows[1].overall_supply_chain_risk_band == "Low" and rows[1].reasons == [fv.NO_SUPPLY_REASON]
    assert "on the buyer concentration and payment reliability side" in rows[0].memo_paragraph


def test_score_weights(spark):
    flags = {n: n in ("commodity_exposure", "import_dependency", "supplier_concentration_high",
                      "customer_concentration_high", "buyer_payment_risk") for n in fv.SUPPLY_KEYWORDS}
    row = filings.supply_scores(spark.createDataFrame([flags])).first()
    assert (row.supplier_risk_score, row.buyer_risk_score, row.overall_supply_chain_risk_score) == (60, 45, 70)


def test_bands(spark):
    frame = spark.createDataFrame([(s,) for s in (0, 20, 21, 40, 41)], ["s"])
    assert [r[0] for r in frame.select(filings.risk_band(F.col("s"))).collect()] == [
        "Low", "Low", "Moderate", "Moderate", "High"]


def test_revenue_figures(spark):
    frame = docs(
        spark, "Revenue from operations for the year ended 31 March 2024 was 1,223.16 Cr.",
        "The Company reported total revenue of ₹ 435.7 Cr.",
        "Revenue from contracts with customers stood at 5,000.00 Cr in FY24.", "EBITDA rose to 12.5 bn.", "Revenue grew 12%.")
    got = {(r.doc_id, r.figure): (r.value, r.unit) for r in filings.extract_figures(frame).collect()}
    assert got[(0, "Revenue")] == (1223.16, "Cr") and got[(1, "Revenue")] == (435.7, "Cr")
    assert got[(2, "Revenue")] == (5000.0, "Cr") and got[(3, "EBITDA")] == (1250.0, "Bn_Cr")
    assert (4, "Revenue") not in got


def brute_audit(text, patterns):
    found = sorted(
        ((m.start(), n, m.end()) for n, p in enumerate(patterns) for m in re.finditer(p, text)), key=lambda m: m[0])
    kept = []
    for m in found:
        if not kept or m[0] >= kept[-1][2]:
            kept.append(m)
    return [(s, e) for s, _, e in kept]


def test_audit_spans_equal_brute_force(spark):
    text = (
        "Opinion. Except for the effects, qualified opinion is given.\n\nThe Company has statutory dues outstanding; GST is "
        "overdue. Going concern basis.\n\nMaterial uncertainty exists. Adverse opinion\n\n" + "x" * 400 + " except for ")
    rows = filings.compliance_matches(docs(spark, text)).collect()
    python = lambda p: p.replace("(?iu)", "(?i)").replace(r"\z", r"\Z")
    kinds = {
        "caro": [python(p) for p in fv.STATUTORY_PATTERNS],
        "qualification": ["(?i)" + python(p + fv.PARAGRAPH_REST) for _, p in fv.QUALIFICATION_PHRASES],
        "emphasis": ["(?i)" + python(p + fv.PARAGRAPH_REST) for _, p in fv.EMPHASIS_PHRASES]}
    for kind, patterns in kinds.items():
        assert sorted((r.start, r.end) for r in rows if r.kind == kind) == brute_audit(text, patterns)
    flags = filings.compliance_flags(docs(spark, text)).first()
    assert flags.triggered_rules == ["P-03", "P-04"]


def test_rating_last_mention_and_downgrade(spark):
    pad = "x" * 100
    frame = docs(spark, pad + " CRISIL AA+ (Stable) then ICRA BB- outlook: negative", pad + " take care about A", pad +
                 " CARE A; was downgraded")
    rows = filings.rating_status(frame).orderBy("doc_id").collect()
    assert (rows[0].latest_agency, rows[0].latest_rating, rows[0].latest_outlook) == ("ICRA", "BB-", "Negative")
    assert rows[0].triggered_rules == ["P-27"] and rows[1].latest_rating is None and rows[1].triggered_rules == []
    assert rows[2].is_investment_grade and rows[2].downgrade_detected


def test_shareholding_prefers_marked_section(spark):
    frame = docs(spark, "promoters hold 12 % today. " + "Category of shareholders: promoter holding: 24.50 %, pledged 61.25 %")
    row = filings.shareholding(frame).first()
    assert (row.promoter_holding_pct, row.pledged_pct, row.triggered_rules) == (24.5, 61.25, ["P-17", "P-18"])


def test_site_rules(spark):
    notes = spark.createDataFrame([(1, "Operating at 40 percent; books maintained."), (2, "Capacity utilisation of 75%"),
                                   (3, "Plant running at 0% today")], "note_id long, notes string")
    rows = prose.site_visit_signals(notes).collect()
    got = {(r.note_id, r.rule_id): r for r in rows}
    assert set(got) == {(1, "P-19"), (1, "P-26"), (3, "P-19")}
    assert got[(1, "P-19")].description == "Factory operating at 40% capacity — below 60% threshold"
    assert got[(3, "P-19")].description.startswith("Factory/plant operating below")
    assert "books maintained" in got[(1, "P-26")].matched_text


def brute_merge(text):
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        line = lines[i].strip()
        if line and len(line) < 80 and line[-1] not in ".!?:;" and i + 1 < len(lines):
            nxt = lines[i + 1].strip()
            if nxt and nxt[0].islower():
                out.append(line + " " + nxt)
                i += 2
                continue
        out.append(line)
        i += 1
    return "\n".join(out)


def test_line_merge_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["abc", "Abc", "abc.", "", " x", "y" * 90, "éa"]) for _ in range(rng.randrange(1, 14)))
             for _ in range(80)]
    rows = docs(spark, *texts).select("text", layout.merge_lines(F.col("text")).alias("m")).collect()
    assert all(r.m == brute_merge(r.text) for r in rows)


def test_clean_text_normalises(spark):
    row = layout.clean_text(docs(spark, "ﬁne “quote” environ-\nment\n-----\n\n\n\nEnd…")).first()
    assert row.text == 'fine "quote" environment\n\nEnd...'


def test_html_blocks_keep_nested_text_and_skip_scripts(spark):
    long = "word " * 10
    html = f"<html><script>var t='{long}';</script><div>Top {long}<p>In&amp;ner {long}</p></div><p>short</p></html>"
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = reports.html_blocks(frame).orderBy("block_no").collect()
    assert [r.text for r in rows] == [
        f"top {long.strip()} in&ner {long.strip()}", f"in&ner {long.strip()}"]


def test_report_files(spark, tmp_path):
    (tmp_path / "acme.txt").write_text("line one\nline two")
    row = reports.read_reports(spark, str(tmp_path)).first()
    assert (row.doc_id, row.text) == ("acme", "line one\nline two")


def test_tone_of_fixed_lexicon(spark):
    text = "Strong growth and profitable expansion, though a write-off and under-recovery may follow. " * 2
    row = prose.lexicon_sentiment(docs(spark, text)).first()
    assert (row.positive_words, row.negative_words, row.uncertain_words) == (10, 4, 2)


def test_phrases_of_the_dictionaries(spark):
    row = prose.ambidexterity(docs(spark, "R&D on a new product; clinical trial in Phase I/II. We optimize production.")).first()
    assert row.exploitation_frequency == 2
    assert {k.keyword for k in row.top_exploration_keywords} == {"R&D", "new product", "clinical trial", "Phase I", "Phase I/II"}


def test_no_break_spaces_match_as_blanks(spark):
    text = "Revenue from operations was 12,345.50 Cr. " + "x " * 60
    plain = text.replace(" ", "\u00a0", 3)
    rows = spark.createDataFrame([(1, 1, "FY1", text), (2, 2, "FY1", plain)], "doc_id long, applicant_id long, fiscal_year string, text string")
    found = {r.doc_id: (r.figure, r.value, r.confidence_score) for r in filings.extract_figures(rows).collect()}
    assert found[1] == found[2]


def test_short_documents_keep_a_rating_row(spark):
    rows = spark.createDataFrame([(1, "short"), (2, None), (3, "rated CRISIL BB- " + "x " * 60)], "doc_id long, text string")
    found = {r.doc_id: (r.latest_rating, r.downgrade_detected, r.triggered_rules) for r in filings.rating_status(rows).collect()}
    assert found[1] == found[2] == (None, False, []) and found[3][0] == "BB-"


def test_company_suffixes_are_cut_after_dots(spark):
    names = ["Foo Pvt. Ltd.", "Foo Pvt Ltd", "Foo Private Limited.", "Foo Corp. Inc", "Foo"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(layout.strip_suffixes(F.col("name")).alias("n")).collect()
    assert [r.n for r in rows] == ["Foo Pvt", "Foo", "Foo", "Foo", "Foo"]


def test_lists_without_a_limit_hold_everything(spark):
    told = " ".join(f"Demand was hit by inflation and weak markets in quarter {n} of the year." for n in range(9))
    assert prose.headwinds(docs(spark, told), k=None).count() == 9 and prose.headwinds(docs(spark, told)).count() == 6
    listed = spark.createDataFrame([("products: a1, b2, c3, d4, e5, f6, g7, h8",)], "t string")
    assert len(listed.select(tx.label_list(F.col("t"), ["products"], None).alias("x")).first().x) == 8
    loans = "unsecured loans from directors. " * 5 + "x " * 80
    rows = spark.createDataFrame([(1, loans)], "doc_id long, text string")
    every, shown = filings.collateral(rows, None, None).first(), filings.collateral(rows).first()
    assert len(every.findings) == every.unsecured_matches == 5 and len(shown.findings) == 2


def test_spans_of_many_matches_equal_python(spark):
    texts = ["x" * k + "ab, " * n + "tail" for k, n in ((0, 1), (3, 63), (1, 64), (2, 65), (0, 700))]
    got = docs(spark, *texts).select("text", sp.spans("text", "(a)(b)", 2).alias("m")).collect()
    for row in got:
        want = [(m.start(), m.end(), m[0], m[1], m[2]) for m in re.finditer("(a)(b)", row.text)]
        assert [tuple(m) for m in row.m] == want


def test_labelled_spans_of_many_matches_never_overlap(spark):
    text = "abcd " * 500
    kept = docs(spark, text).select(sp.labelled_spans("text", [("long", "bcd a"), ("short", "abc"), ("one", "d")]).alias("m")).first().m
    want, end = [], 0
    for start, order, stop, label in sorted(
            (m.start(), n, m.end(), name) for n, (name, p) in enumerate([("long", "bcd a"), ("short", "abc"), ("one", "d")])
            for m in re.finditer(p, text)):
        if not want or start >= end:
            want.append((start, stop, label))
            end = stop
    assert [(m.start, m.end, m.label) for m in kept] == want and len(want) == 1000


def test_section_texts_hold_the_pages_of_their_range(spark):
    pages = [(1, p, f"page {p} of one") for p in range(1, 101)] + [(2, 1, None), (2, 2, "two")] + [(3, 1, "no section")]
    sections = [(1, "auditors_report", 3, 5), (1, "auditors_annexure", 5, 40), (1, "mda_report", 99, 300), (2, "mda_report", 1, 11), (9, "mda_report", 1, 2), (3, "mda_report", 5, 4)]
    pages = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    sections = spark.createDataFrame(sections, "doc_id long, section string, start_page int, end_page int")
    for rows in (layout.STRETCH_ROWS, 0):
        before, layout.STRETCH_ROWS = layout.STRETCH_ROWS, rows
        got = {(r.doc_id, r.section): r for r in layout.section_texts(pages, sections).collect()}
        layout.STRETCH_ROWS = before
        assert {k: r.pages_extracted for k, r in got.items()} == {
            (1, "auditors_report"): 3, (1, "auditors_annexure"): 36, (1, "mda_report"): 2, (2, "mda_report"): 2}
        assert got[1, "mda_report"].text == "--- Page 99 ---\npage 99 of one\n\n--- Page 100 ---\npage 100 of one"
        assert got[2, "mda_report"].text == "--- Page 1 ---\n\n\n--- Page 2 ---\ntwo"


def test_audit_scan_reads_report_and_annexure_only(spark):
    scans = spark.createDataFrame([
        (1, 10, "FY2024", "Undisputed statutory dues remain outstanding. Except for this."), (2, 20, "FY2024", "x")],
        "applicant_id long, doc_id long, fiscal_year string, text string")
    sectioned = spark.createDataFrame([
        (10, "mda_report", "Except for the weather.\n\n"), (20, "auditors_report", "Except for the matter above.\n\n"),
        (20, "auditors_annexure", "Undisputed statutory dues including provident fund remain outstanding")], "doc_id long, section string, text string")
    flags = lambda s: {r.doc_id: (r.caro_default_found, r.adverse_opinion_found) for r in filings.compliance_flags(portfolio.audit_texts(scans, s)).collect()}
    assert flags(None)[10] != (False, False)
    assert flags(sectioned) == {10: (False, False), 20: (True, True)}


def test_rating_status_without_a_downgrade_has_no_details(spark):
    text = "Facilities rated CRISIL AA+ with outlook: stable. " * 3
    rows = filings.rating_status(docs(spark, text, text + "The rating was downgraded during the year.")).orderBy("doc_id").collect()
    assert [(r.downgrade_detected, r.downgrade_details is None) for r in rows] == [(False, True), (True, False)]
    assert "downgraded" in rows[1].downgrade_details and len(rows[1].downgrade_details) < 150


def test_bounds_of_the_original_may_be_lifted(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "x" * 70 + " fraud one. " + "x" * 70 + " fraud two" + "y" * 300)], "applicant_id long, page_id long, block_no int, text string")
    hits = lambda **k: sorted(r.sentence for r in prose.adverse_hits(blocks, [("fraud", 1.0)], [], **k).collect())
    assert [len(s) for s in hits()] == [80] and [len(s) for s in hits(opening=None, shown=None)] == [80, 380]
    page = spark.createDataFrame([("a" * 4000 + "\nAlpha Works Ltd\nAnnual Report",)], "p string")
    title = lambda **k: page.select(layout.title_candidate(F.col("p"), **k)).first()[0]
    assert title() is None and title(read=None) == "Alpha Works Ltd"
    wide = docs(spark, "shareholding pattern 11.11 " + "z" * 9000 + " promoter holding: 55.5 % of shares")
    held = lambda **k: filings.shareholding(wide, **k).first().promoter_holding_pct
    assert held(section_length=None) == 55.5


def test_company_names_that_hold_the_digits_of_a_year(spark):
    page = lambda name: f"FY20\n{name}\n2019-20\nAnnual Report\nIs and"
    rows = [(n, "AnnualReport_2019CDEL.pdf", page(name)) for n, name in enumerate(
        ["Beta Works 2001 Limited", "Beta Works 7 Limited", "As of 2001", "Integrated 2001 Limited"])]
    covers = spark.createDataFrame(rows, "doc_id long, file_name string, first_page string")
    names = lambda **k: [r.entity_name for r in layout.entity_name(covers, **k).orderBy("doc_id").collect()]
    other = "Coffee Day Enterprises"
    assert names() == [other, "Beta Works 7", other, other]
    assert names(numbered=True) == ["Beta Works 2001", "Beta Works 7", other, other]


def test_a_plain_search_goes_before_costly_patterns(spark):
    """With and without it the outcome is the same; a text without a keyword is spared the pattern."""
    random.seed(3)
    parts = ["no ", "commodity prices", "commodity", ", ", ".", "few suppliers", "not many ", "weather", "top customer 45 % ", "\n",
             "receivable days rose from 5 to 20", "collection period rose from 5 to 9 "]
    texts = ["".join(random.choices(parts, k=6)) for _ in range(200)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    col, words = F.col("t"), ["commodity", "commodity prices", "weather", "few suppliers"]
    pairs = [(tx.contains_any(col, words, lowered=low), tx.percent_near(col, "top customer", lowered=low), tx.days_jump(col, lowered=low))
             for low in (True, False)]
    assert all(r.a == r.b for r in rows.select(F.struct(*pairs[0]).cast("string").alias("a"), F.struct(*pairs[1]).cast("string").alias("b")).collect())
    for pattern in (tx.contains_any(col, words, lowered=True), tx.percent_near(col, "top customer", lowered=True)):
        assert "Contains(" in rows.select(pattern.alias("p"))._jdf.queryExecution().optimizedPlan().toString()


def test_every_match_of_a_figure_holds_its_needles():
    said = {
        "Revenue": ["revenue from operations", "revenue from contracts with customers", "total income", "revenue of", "revenue 12345", "total revenue 1234"],
        "EBITDA": ["cash ebitda", "ebitda", "operating profit"],
        "PAT": ["loss for the year amounting to", "profit for the period", "net loss after tax"],
        "Total Debt": ["total borrowing", "long term borrowing", "total financial liabilities"],
        "Net Worth": ["total equity", "shareholders fund", "net worth"]}
    for name, (patterns, _) in fv.FIGURE_PATTERNS.items():
        for pattern, needles, start in zip(patterns, fv.FIGURE_NEEDLES[name], said[name], strict=True):
            assert all(any(word in start for word in needle.split("|")) for needle in needles), (name, start)


def test_html_blocks_of_many_pages_in_slices(spark):
    pages = [(n, n % 3, None if n % 7 == 0 else f"<div>{'x' * 40} {n}<p>{'y' * 40} {n}</p></div>") for n in range(250)]
    frame = reports.html_blocks(spark.createDataFrame(pages, "page_id long, applicant_id int, html string").coalesce(1), ("page_id", "applicant_id"))
    assert "MapInArrow" in frame._jdf.queryExecution().toString() and reports.PAGES_AT_ONCE < 250
    assert sorted(map(tuple, frame.collect())) == sorted(
        (n, a, no, text) for n, a, html in pages for no, text in enumerate(reports.page_blocks(html or "")))
