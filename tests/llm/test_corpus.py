"""Decontamination, mixing, quality rules, the pipeline and the queries' SQL."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from lendgrain.llm import decontamination, mixing, quality_rules
from lendgrain.llm.queries import CHECKS, QUERIES
from tests.llm import brute
from tests.llm.conftest import EDGES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def leaky(prose):
    items = [(i, prose(30 + i, 500 + i, 99)) for i in range(8)] + [(90, None), (91, ""), (92, "too short a text")]
    rows = [(d, prose(80, d)) for d in range(20)]
    for d in range(6):
        w = (items[d][1] or "").split()
        w[10:10] = ["put", "in"][:d % 3]
        rows.append((100 + d, f"{prose(40, d + 40)} {' '.join(w).upper().replace('Ä', 'ä')} {prose(20, d + 60)}"))
    rows += [(200, items[3][1]), (201, " ".join(items[3][1].split()[:20])), (202, items[4][1] + " " + items[5][1])]
    return rows + EDGES, items


def test_leaks_against_brute_force(spark, frame, leaky):
    rows, items = leaky
    got = decontamination.leaks(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.leaks(rows, items)
    assert len(want) >= 6 and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    whole = next(r for r in got if r.doc_id == 200 and r.item_id == 3)
    assert (whole.start_word, whole.n_words, whole.similarity) == (0, 33, 1.0)


def test_leaks_do_not_depend_on_blocks_of_items(spark, frame, leaky, monkeypatch):
    rows, items = leaky
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 3)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(rows), bench).collect()} == brute.leaks(rows, items)
    kept = decontamination.decontaminated(frame(rows), bench)
    dirty = {d for d, _ in brute.leaks(rows, items)}
    assert kept.schema == frame(rows).schema and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows if d not in dirty)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(frame(rows), empty).count() == 0 and decontamination.decontaminated(frame(rows), empty).count() == len(rows)


def water_filled(sizes, cap=3, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest} | {s: cap * sizes[s] for s in full}
        over = {s for s in rest if target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_targets(spark, frame, prose):
    r = random.Random(4)
    rows = [(d, prose(r.randint(0, 90), d)) for d in range(400)] + [(d, prose(2500, d)) for d in (1000, 1001)]
    rows += [(2004 + 5 * i, "tiny source") for i in range(2)] + EDGES + [(7, prose(50, 7))] * 3
    docs = frame(rows)
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for row in got:
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        assert 0 <= row.taken <= 3 * row.size
    want = water_filled(sizes)
    for row in got:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(want[row.source])
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, rel=0.02)
    again = mixing.taken_words(docs.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert mixing.taken_words(frame([])).count() == 0


def test_mixed_spans_fill_their_slots(spark, frame, prose):
    spans = mixing.mixed_spans(frame([(d, prose(70, d)) for d in range(50)]), block_words=20).toPandas()
    by_slot = spans.groupby(["shard", "position"]).n_words.sum()
    assert by_slot.max() <= 20 and spans.groupby(["shard", "position"]).block.nunique().max() == 1


def test_last_stage_returns_the_mix(spark, frame, prose):
    rows = [(d, prose(70 + d, d)) for d in range(30)] + [(7, prose(77, 907)), (7, prose(77, 7)), (None, prose(50, 8))]
    docs = frame(rows)
    got = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in got} <= set(rows)
    slots = Counter()
    for r in got:
        assert r.size == len(r.text.split()) and r.taken == sum(s.n_words for s in r.stretches) > 0
        assert all(0 <= s.first_word and s.first_word + s.n_words <= r.size for s in r.stretches)
        slots.update((s.shard, s.position, r.doc_id, s.first_word, s.n_words) for s in r.stretches)
    want = mixing.mixed_spans(docs).collect()
    assert slots == Counter((r.shard, r.position, r.doc_id, r.first_word, r.n_words) for r in want)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 37):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(99).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], CHECKS[name], SF) is None


def test_rules_on_odd_texts(spark, frame, prose):
    rows = [*EDGES, (1, prose(80, 1)), (2, "go on " * 60), (3, "# * $ " * 60), (4, prose(80, 1) + "\n" + prose(80, 1)), (1, prose(80, 1))]
    got = quality_rules.verdicts(frame(rows)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by_id[9001].n_words == 0 and by_id[9001].base_failed and not by_id[9001].kept
    assert by_id[1].kept and not by_id[2].kept and not by_id[3].kept and by_id[4].n_repeat_words == 160 and by_id[4].n_dup_lines == 7
    passing = quality_rules.passing(frame(rows))
    assert passing.columns == frame(rows).columns and [r.doc_id for r in passing.collect()] == [1, 1]
    assert quality_rules.passing(frame([])).count() == 0


def test_pipeline_against_brute_force(spark, frame, leaky, prose, tmp_path):
    rows, items = leaky
    rows = [(d, t) for d, t in rows if d is not None]
    rows += [(300 + d, prose(80, d) + " tail") for d in range(4)] + [(310, "# * $ " * 60), (311, prose(90, 3) + "\n" + prose(24, 5))]
    frame(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    passed = {r.doc_id for r in quality_rules.verdicts(frame(rows)).filter("kept").collect()}
    left = [(d, t) for d, (t, n) in brute.line_dedup([r for r in sorted(rows, key=lambda r: r[0]) if r[0] in passed]).items()
            if not n or brute.words(t)]
    left = [r for r in left if brute.near(left, corpus_pipeline.NEAR_PERCENT)[r[0]][2]]
    dirty = {d for d, _ in brute.leaks(left, items)}
    want = {d: len(brute.words(t)) for d, t in left if d not in dirty}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert dirty and set(got) <= set(want) and all(got[d].size == want[d] for d in got)
    target = water_filled(Counter({s: sum(n for d, n in want.items() if (None if d % 5 == 4 else f"s{d % 5}") == s)
                                   for s in {None if d % 5 == 4 else f"s{d % 5}" for d in want}}))
    taken = Counter()
    for r in got.values():
        taken[r.source] += r.taken
    for source, words in target.items():
        assert taken[source] == pytest.approx(words, rel=0.05)


def test_stages_return_the_columns_of_documents(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near-duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_all_queries_are_registered():
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
