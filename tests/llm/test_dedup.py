"""Near-duplicates, lines and byte strings against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lendgrain.llm import line_dedup, near_dup, substring_dedup, words
from lendgrain.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import EDGES


def copies(prose, groups, seed, words=60):
    """Texts with copies of them, each with some words changed."""
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(words, seed + g)
        rows.append(base)
        for _ in range(r.randint(0, 12)):
            w = base.split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_are_all_found(spark, frame, prose):
    rows = copies(prose, 12, 3) + copies(prose, 3, 90, 9)
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(d, t) for d, t in EDGES if d is not None]
    for percent in (80, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(rows), percent).collect()}
        assert got == brute.near(rows, percent)


def test_near_duplicates_keep_rows_without_number_and_repeated_rows(spark, frame, prose):
    rows = [*EDGES, (1, prose(40, 1)), (1, prose(40, 1)), (2, prose(40, 1))]
    kept = near_dup.representatives(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 9001, 9002, 9003, 9004]
    assert near_dup.near_duplicates(frame([])).count() == 0


def test_densified_bins_come_from_the_same_text():
    signature = np.full((3, near_dup.BINS), near_dup.EMPTY)
    signature[0, 5], signature[1, [1, 200]], signature[2] = 9, (7, 8), np.arange(near_dup.BINS)
    full = near_dup.densified(signature)
    assert set(full[0]) == {9} and set(full[1]) == {7, 8} and (full[2] == np.arange(near_dup.BINS)).all()


def test_band_agreement_follows_similarity():
    r = np.random.default_rng(1)
    same = 0
    for _ in range(300):
        pool = np.unique(r.integers(0, 2**64, 110, dtype=np.uint64))
        pairs = [np.sort(pool[:100]), np.sort(pool[8:108])]  # similarity 0.85
        keys = [near_dup.band_keys(np.zeros(100, int), p, 1) for p in pairs]
        same += bool((keys[0] == keys[1]).any())
    assert same == 300


def test_bands_follow_the_threshold():
    assert [near_dup.rows_for(p) for p in (85, 80)] == [8, 6]
    for percent in range(60, 101):
        rows = near_dup.rows_for(percent)
        assert (1 - (percent / 100) ** rows) ** (near_dup.BINS // rows) <= 4e-5
    assert near_dup.band_keys(np.zeros(9, int), np.arange(9, dtype=np.uint64), 1, 6).shape == (1, 42)


def edited(text, r):
    i, kind = r.randrange(len(text) + 1), r.randrange(3)
    return text[:i] + (r.choice("xé") if kind else "") + text[i + (kind != 1):]


def test_lines_against_brute_force(spark, frame):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(n)).strip() for n in (9, 10, 11, 12, 64, 65, 130, 300, 1200) for _ in range(4)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randrange(8)):
            line = r.choice(base)
            for _ in range(r.randrange(3)):
                line = edited(line, r)
            lines.append(line)
        rows.append((d, "\n".join(lines)))
    rows += EDGES
    got = line_dedup.deduplicated(frame(rows))
    assert got.columns == [c for c in frame(rows).columns if c != "n_removed"] + ["n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in got.collect()} == brute.line_dedup(rows)


def test_short_lines_go_if_equal(spark, frame, tmp_path):
    rows = [(1, "menu\n\nx\nmenu \na longer line of text"), (2, " menu\nmenus\n\nx\nb longer line of text"), (3, "only new"), (4, "only new\nx")]
    want = {1: ("menu\n\nx\na longer line of text", 1), 2: ("menus\n", 3), 3: ("only new", 0), 4: ("", 2)}
    got = line_dedup.deduplicated(frame(rows), short=True).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == want
    frame(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_removed, r.kept_chars) for r in got} == {d: (n, len(t)) for d, (t, n) in want.items()}
    docs = corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.text for r in docs.collect()} == {d: t for d, (t, _) in want.items() if t}


def test_lines_of_a_hot_template_keep_the_earliest(spark, frame):
    rows = [(d, f"copyright {chr(97 + d % 26)} all rights reserved") for d in range(300)]
    got = line_dedup.deduplicated(frame(rows)).filter("n_removed = 0").collect()
    assert [r.doc_id for r in got] == [0]
    assert line_dedup.deduplicated(frame([])).count() == 0


def test_rows_of_one_doc_id_with_different_texts_keep_their_own_lines(spark, frame):
    shared = "the shared line of all"
    rows = [(1, f"{shared}\nfirst"), (5, f"{shared}\nno other has this"), (5, f"unique opening of the second row\n{shared}"), (5, f"{shared}\nno other has this")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.deduplicated(frame(rows)).collect())
    assert got == [
        (1, f"{shared}\nfirst", 0), (5, "no other has this", 1), (5, "no other has this", 1), (5, "unique opening of the second row", 1)]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_of_a_structure_that_polynomials_confuse_are_not_linked(spark, frame):
    rows = [(1, thue_morse(2048, "a", "b")), (2, thue_morse(2048, "b", "a")), (3, thue_morse(2048, "b", "a"))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(rows)).collect()}
    assert got == brute.near(rows, 85) == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 2, False)}


def test_byte_strings_against_brute_force(spark, frame, prose):
    r = random.Random(8)
    passage, rows = prose(60, 77, 99), []
    for d in range(40):
        parts = [prose(r.randint(1, 50), 100 + d, 99), passage[r.randrange(80):len(passage) - r.randrange(80)], prose(30, 200 + d % 7, 99)]
        rows.append((d, " ".join(parts[:r.randint(1, 3)])))
    rows += [(50, "ab" * 400), (51, "ab" * 90), (52, "x" * 99), (53, "x" * 99), (54, "é" * 120)] + [e for e in EDGES if e[0] is not None]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.without_repeats(frame(rows)).collect()}
    assert got == brute.repeats(rows)


def test_byte_strings_of_rows_without_number_stay(spark, frame, prose):
    text = prose(60, 1)
    got = substring_dedup.without_repeats(frame([(None, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (2, len(text.encode()))]
    assert substring_dedup.without_repeats(frame([])).count() == 0


def test_words_are_hashed_by_their_bytes_alone():
    r = random.Random(3)
    made = ["".join(r.choice("abAé0") for _ in range(r.choice((1, 3, 7, 8, 9, 16, 17, 40)))) for _ in range(4000)]
    made += ["x" * n for n in (4095, 4096, 4097, 9000)] + [thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")]
    texts = words.Texts(pa.array([" ".join(made[:1000]), "", *made[1000:], " \n".join(made)]))
    hashes = words.hashes_of_words(texts, *texts.words())
    known = {}
    for word, pair in zip(made + made, hashes.tolist()):
        known.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), word), set()).add(tuple(pair))
    assert len(hashes) == 2 * len(made) and all(len(pairs) == 1 for pairs in known.values())
    for side in (0, 1):
        assert len({next(iter(pairs))[side] for pairs in known.values()}) == len(known)
