"""Spelling variants, exact search and phrases against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lendgrain.llm import exact_search, phrases, spelling
from tests.llm.conftest import EDGES


# --- Spelling ------------------------------------------------------------------------
def vocabulary(rows, min_chars=7, slip=31):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if slip and d is not None and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= min_chars
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def variants(n, ratio=10):
    out = {}
    for w, c in n.items():
        others = sorted((-n[x], x) for x in n if near(w, x))
        form = others[0][1] if others and -others[0][0] >= ratio * c else None
        out[w] = (c, len(others), form, n[form] if form else None)

    def root(w):
        return w if out[w][2] is None else root(out[w][2])
    return {w: (*v, root(w)) for w, v in out.items()}


def words_around(r, base, times):
    made = []
    for w in base:
        made += [w] * times
        for _ in range(8):
            i, kind = r.randrange(len(w) + 1), r.randrange(3)
            made += [w[:i] + (r.choice("abcàÉ×") if kind else "") + w[i + (kind != 1):]] * r.choice((1, 2, 2, 5, 60))
    r.shuffle(made)
    return made


def test_spelling_variants_against_brute_force(spark, frame):
    r = random.Random(4)
    base = ["".join(r.choice("abcdeàÉ") for _ in range(n)) for n in (7, 7, 8, 9, 12, 30) for _ in range(4)]
    made = words_around(r, base, 700) + ["aaaaaaa", "aaaaaaab", "AAAAAAA"] * 3
    rows = [(d, " ".join(made[d::40])) for d in range(40)] + EDGES + [(None, "slipless slipless"), (3, "x" * 5000 + " " + "x" * 5000)]
    n = vocabulary(rows)
    got = spelling.vocabulary(frame(rows))
    assert {x.word: x.n for x in got.collect()} == n
    found = spelling.variants(got).collect()
    assert {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in found} == variants(n) and len(found) == len(n)
    assert any(v[4] != v[2] for v in variants(n).values() if v[2])  # some chains are longer than one form
    assert spelling.variants(spelling.vocabulary(frame([]))).count() == 0


@pytest.mark.parametrize("symbols", [2, 8, 16])
def test_each_near_pair_meets_once(spark, symbols):
    r = random.Random(symbols)
    words = sorted({"".join(r.choice("abz") for _ in range(n)) for n in (5, 6, 6, 7) for _ in range(60)} | {"", "a", "b", "ab"})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [tuple(sorted((x.word, x.near))) for x in spelling.near_pairs(frame, symbols).collect()]
    assert sorted(got) == [(a, b) for i, a in enumerate(words) for b in words[i + 1:] if near(a, b)]


# --- Exact search --------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, id string, score double"


def matches(rows, k=20, scale=64):
    usable = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = {}
    for q, w in usable:
        if q % 20 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)[:k]
            out[q] = [(rank, i, -s) for rank, (s, i) in enumerate(ranked, 1)]
    return out


def found(frame, **options):
    out = {}
    for x in exact_search.top_matches(frame, F.col("vec_id") % 20 == 0, **options).collect():
        out.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    return {q: sorted(v) for q, v in out.items()}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], VECTORS)


def test_exact_search_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, [r.choice((0.0, 0.0, r.uniform(-1, 1))) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]  # ties
    rows += [(400, None), (420, [1.0, None]), (421, [float("nan")]), (440, [float("inf"), 1.0]), (None, [1.0]), (460, []), (461, [5.0])]
    rows += [(480, [1e30, -1e30, 3.0]), (481, [-1e30] * 12), (21, rows[21][1]), (21, rows[21][1])]
    want = matches([(i, None if v is None else [None if x is None else max(-(2.0 ** 24) / 64, min(2.0 ** 24 / 64, x)) if np.isfinite(x) else x for x in v])
                    for i, v in rows])
    assert 480 in want and len(want[0]) == 20
    for options in ({}, {"query_group": 5, "shares": 3}, {"shares": 1}):
        assert found(vectors(spark, rows), **options) == want
    monkeypatch.setattr(exact_search, "ABREAST", 3)
    for block in (exact_search.BLOCK, 7):
        monkeypatch.setattr(exact_search, "BLOCK", block)
        assert local(rows, 20) == want


def local(rows, k):
    """The cells' work without Spark: all queries and candidates in one cell."""
    usable = [(i, [int(np.clip(np.floor(64 * float(np.float32(x))), -2**24, 2**24)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    kinds = [(0, i, w) for i, w in usable if i % 20 == 0] + [(1, i, w) for i, w in usable]
    batch = pa.RecordBatch.from_arrays([
        pa.array([0] * len(kinds), pa.int32()), pa.array([x[0] for x in kinds], pa.int32()), pa.array([x[1] for x in kinds], pa.int64()),
        pa.array([x[2] for x in kinds], pa.list_(pa.int32()))], names=["cell", "kind", "id", "weights"])
    out = {}
    for piece in exact_search._cells(k)(iter([batch.slice(0, 50), batch.slice(50)])):
        for x in piece.to_pylist():
            out.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
    return {q: [(rank, i, -s) for rank, (s, i) in enumerate(sorted(v), 1)] for q, v in out.items()}


def test_exact_search_of_few_or_no_rows(spark):
    assert found(vectors(spark, [])) == {}
    assert found(vectors(spark, [(20, [1.0])])) == {}
    assert found(vectors(spark, [(20, [1.0]), (40, [2.0]), (41, [3.0])])) == {
        20: [(1, 41, 12288), (2, 40, 8192)], 40: [(1, 41, 24576), (2, 20, 8192)]}
    repeated = vectors(spark, [(20, [2.0]), (20, [1.0]), (3, [1.0]), (3, [1.0])])
    assert found(repeated) == {20: [(1, 3, 4096), (2, 3, 4096)]}


# --- Phrases -------------------------------------------------------------------------
def collocations(rows, least=30, inside=80, most=2000):
    f, out = {}, []
    for lang, text in rows:
        f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        parts = {}
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    parts[p[i:i + m]] = max(parts.get(p[i:i + m], 0), a)
        rows_of = []
        for p, a in candidates.items():
            if 100 * parts.get(p, 0) >= inside * a:
                continue
            s, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_of.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows_of)[:most], 1)]
    return sorted(out)


def texts_of(seed):
    r = random.Random(seed)
    fixed = ["New York City", "in order to", "red rose", "été à la", "a b c"]
    rows = []
    for d in range(120):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice(["the", "of", "Ab", "xyz", "q\x01"]) for _ in range(60)]
        rows.append((r.choice(["en", "en", "fr", None, "und"]), "".join(p + r.choice([" ", "\t ", ", ", "\n", ".\x0b"]) for p in parts)))
    return rows + [("en", None), ("en", ""), ("de", "one"), ("xx", "..;"), rows[0], rows[0]]


def docs_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, l, 1, "k", 2) for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, key string, phrase int")


def test_phrases_against_brute_force(spark):
    rows = texts_of(2)
    for options, limits in (({}, {}), ({"min_count": 3, "inside_percent": 50, "per_lang": 7}, {"least": 3, "inside": 50, "most": 7})):
        got = phrases.collocations(docs_of(spark, rows).repartition(5), **options).collect()
        assert sorted(tuple(x) for x in got) == collocations(rows, **limits)
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [("en", None), (None, ",")])).count() == 0


def test_the_bit_map_only_lets_more_through(spark, monkeypatch):
    rows = texts_of(5)
    monkeypatch.setattr(phrases, "MAP_BITS", 16)
    got = phrases.collocations(docs_of(spark, rows), min_count=5).collect()
    assert sorted(tuple(x) for x in got) == collocations(rows, 5)


def test_fingerprints_tell_order_piece_and_language():
    texts = phrases.Texts(pa.array(["a b a", "a. b", "", "B A"]))
    runs = phrases.Runs(texts, ["en", "en", "en", "fr"])
    pairs = runs.first(2)
    assert len(pairs) == 3 and len(set(runs.fingerprints(pairs, 2, 0))) == 3
    same = phrases.Runs(phrases.Texts(pa.array(["x y a b"])), ["en"])
    assert runs.fingerprints(pairs[:1], 2, 1)[0] == same.fingerprints(np.array([2]), 2, 1)[0]
