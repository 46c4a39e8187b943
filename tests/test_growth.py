"""What keeps the work of whole-portfolio queries in step with their input."""

from __future__ import annotations

import re
import threading

from lendgrain.functions.text import letter_first
from lendgrain.operators import base_terms
from lendgrain.plans import bindings, portfolio, verify_queries
from lendgrain.sources import statements

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_chosen_filings_are_settled(spark):
    texts = spark.createDataFrame(
        [(1, 1, "FY2020", "old"), (2, 1, "FY2021", "new"), (3, 2, "FY2019", "only")],
        "doc_id long, applicant_id long, fiscal_year string, text string")
    chosen = portfolio.latest_filings(texts)
    assert "Join" not in plan(chosen)  # a filter on a signal of the text stays above the choice
    assert sorted(tuple(r) for r in chosen.select("doc_id", "text").collect()) == [(2, "new"), (3, "only")]


def test_yearly_sums_are_made_once(spark):
    assert plan(bindings.figures(spark, SF)).count("Aggregate") == 1


def test_notes_are_spread(spark):
    assert "RepartitionByExpression" in plan(bindings.NOTES.frame(spark, SF))


def test_letter_before_boundary_matches_the_same():
    assert letter_first(r"\bvacant\b") == r"(?=v)\bvacant\b"
    for kept in (r"\b(\d{1,3})\s*%", r"\bx?y", r"running\s+at", r"\bx{0,2}y"):
        assert letter_first(kept) == kept
    for text in ("vacant", "a vacant one", "avacant", "vacants"):
        assert bool(re.search(letter_first(r"\bvacant\b"), text)) == bool(re.search(r"\bvacant\b", text))


def test_columns_are_found_once_per_file(spark, tmp_path):
    wide = "Date,Narration,Withdrawal,Deposit," + ",".join(f"x{i}" for i in range(70))
    (tmp_path / "1.csv").write_text("Date,Narration,Withdrawal,Deposit\n2024-01-05,short,7\n2024-01-06,long,8,9,10,11\n")
    (tmp_path / "2.csv").write_text(wide + "\n2024-01-07,wide,1,2," + ",".join("0" * 70) + "\n")
    rows = statements.read_statement_folder(spark, str(tmp_path))
    assert "array_position" not in plan(rows)
    assert sorted(tuple(r) for r in rows.select("applicant_id", "description", "debit", "credit").collect()) == [
        (1, "long", 8.0, 9.0), (1, "short", 7.0, 0.0), (2, "wide", 1.0, 2.0)]


def test_evidence_meets_in_short_chains(spark):
    checks = verify_queries.rolled(spark, SF)
    joins = plan(checks).count("Join LeftOuter")
    assert joins < 9, joins  # one for each evidence table before


def test_forests_grow_side_by_side(spark, monkeypatch):
    both, fit = threading.Barrier(2, timeout=60), base_terms.RandomForestRegressor.fit
    monkeypatch.setattr(base_terms.RandomForestRegressor, "fit", lambda self, rows: (both.wait(), fit(self, rows))[1])
    train = spark.range(40).selectExpr("id AS applicant_id", "1 + id % 2 AS dscr", "9.0 + id % 2 AS base_rate", "10.0 - id % 2 AS base_limit")
    model = base_terms.fit_base_terms(train, trees=2, depth=2, least_leaf=1)
    assert [s.getLabelCol() for s in model.stages[2:]] == ["base_rate", "base_limit"]
