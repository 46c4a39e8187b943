"""Extraction, personal data and the learnt scores."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lendgrain.llm import extraction, labelled, pii, quality, toxicity
from lendgrain.llm.html_blocks import blocks_of
from lendgrain.llm.words import Texts
from tests.llm.conftest import EDGES


def page(body, extra=""):
    return (f"<html><head><title>t</title><style>p {{}}</style><script>var a = '<p>no</p>';</script></head><body>"
            f"<div class='site-header'>Our site</div><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
            f"<article><h1>Title</h1>{body}<aside>aside</aside></article>{extra}<footer>&copy; us</footer></body></html>")


CASES = [
    (page("<p>One &amp; two<p>three\n  four<br>five"), "Title\nOne & two\nthree four five"),
    (page("<p>a <b>bold</b> <i>word</i></p><ul><li>x<li>y</ul>"), "Title\na bold word\nx\ny"),
    (page("<p>kept</p><section id='comments'><p>reader says</p></section><form><p>mail</p></form>"), "Title\nkept"),
    (page("<p>a &lt; b &#233;&#x41; &am"), "Title\na < b éA &am"),
    (page("<p>seen <span style='display:none'>unseen</span></p><p hidden>gone</p><!-- no <p>x</p> -->"), "Title\nseen"),
    ("<p>no frame <b>at all", "no frame at all"),
    ("<main><p>inside</p></main><p>outside</p>", "inside"),
    ("just text", "just text"), ("", ""), (None, ""), ("<p>cut <a hre", "cut"), ("a < b and c > d", "a < b and c > d"),
]


def test_main_text_of_single_pages(spark):
    rows = [(i, f"http://h{i}.org/x", html) for i, (html, _) in enumerate(CASES)] + [(None, None, CASES[0][0])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS low", "2 AS text")
    got = extraction.main_texts(frame)
    assert got.columns == ["page_id", "url", "text"]
    by_id = {r.page_id: r.text for r in got.collect()}
    assert by_id == {i: text for i, (_, text) in enumerate(CASES)} | {None: CASES[0][1]}
    assert extraction.main_texts(frame.limit(0)).count() == 0


def test_style_tree_removes_what_pages_of_a_host_share(spark, prose):
    html = "<div><div class='q1'>Top stories of {}</div><div class='z'><p>{}</p><p>{}</p></div><div class='y'>Made by us</div></div>"
    rows = [(i, "http://one.org/" + str(i), html.format(["today", "the week"][i % 2], prose(20, i, 99), prose(9, 99 + i, 99))) for i in range(30)]
    rows += [(100 + i, "http://copies.org/" + str(i), html.format("x", prose(20, 7, 99), prose(9, 8, 99))) for i in range(30)]
    got = {r.page_id: r.text for r in extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(20, i, 99) + "\n" + prose(9, 99 + i, 99) for i in range(30))
    assert all(got[100 + i].startswith("Top stories") and prose(20, 7, 99) in got[100 + i] for i in range(30))  # one page, many times


def test_copies_that_differ_in_furniture_keep_their_article(spark, prose):
    """Hosts with 3 articles on 40 pages that differ in menu, advert and date; one also with headings that recur."""
    frame = "<div class='q'>Date {0}</div><div class='menu'>Menu {0}</div><div class='ad'>Buy {0}</div>{1}<div class='y'>Made by us</div>"
    rows = [(i, f"http://plain.org/{i}", frame.format(i, f"<div class='z'><p>{prose(30, i % 3, 99)}</p></div>")) for i in range(40)]
    rows += [(100 + i, f"http://tagged.org/{i}", frame.format(i, f"<article><p>{prose(30, i % 3, 99)}</p></article>")) for i in range(40)]
    rows += [(200 + i, f"http://heads.org/{i}", frame.format(
        i, f"<article><h2>{['Overview', 'Results'][i % 2]}</h2><p>{prose(30, i, 99)}</p></article>")) for i in range(40)]
    got = {r.page_id: r.text for r in extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(prose(30, i % 3, 99) in got[i] and got[100 + i] == prose(30, i % 3, 99) for i in range(40))
    assert all(got[200 + i] == ["Overview", "Results"][i % 2] + "\n" + prose(30, i, 99) for i in range(40))


def test_parsing_is_linear_in_broken_pages():
    assert len(blocks_of("<p>x <a b='" * 2000)[0]) <= 2000
    assert blocks_of("<div>" * 3000 + "deep")[0][0].text == "deep"


WRAPPED = [
    "<html class='cookies'><body class='no-sidebar single-post'>{}</body></html>",
    "<body><div id='page' class='has-sidebar'>{}</div></body>", "<main class='with-menu'>{}</main>",
    "<div class='has-sidebar'><div class='share-page'><main>{}</main></div><footer>foot</footer></div>",
]
INNER = [
    ("<article class='post has-sidebar'><h2 class='section-header'>Head</h2><p>Body of it<table><tr class='header'><td>A<td class='menu'>B</table>"
     "<div class='share'>share</div><article class='comment'>first!</article></article><div id='comments'><article class='comment'>me too</article></div>",
     ["Head", "Body of it", "A", "B"]),
    ("<p>A page of plain text, longer than the rest<div class='sidebar'>side</div>", ["A page of plain text, longer than the rest"]),
]


@pytest.mark.parametrize("wrapper", WRAPPED)
@pytest.mark.parametrize("inner, want", INNER)
def test_marked_wrappers_keep_the_article(wrapper, inner, want):
    assert extraction.chosen(blocks_of(wrapper.format(inner))[0], set()) == want


PROSE = "The main text of the page is long enough to count as prose, with more than eighty characters in it."


@pytest.mark.parametrize("html, want", [
    (f"<head><title>x</title><body><p>{PROSE}", PROSE),
    (f"<head><meta charset=utf-8><title>x</title><article><p>{PROSE}</p></article>", PROSE),
    (f"<head><title>x</title>{PROSE}<p>{PROSE}", f"{PROSE}\n{PROSE}"),
    (f"<body><form id=aspnetForm><nav>menu</nav><div><p>{PROSE}</p></div></form>", PROSE),
    (f"<body><p>{PROSE}</p><form><label>Your name</label></form>", PROSE),
    (f"<body><div><aside><p>side</p><article><p>{PROSE}</p></article></div>", PROSE),
    (f"<body><div><aside><p>{PROSE}</p><p>{PROSE}</p></aside><p>{PROSE} Own.</p></div>", f"{PROSE} Own."),
    (f"<main><p>{PROSE}</p><article class=card>one</article><article class=card>two</article></main>", PROSE),
    (f"<div id=content><p>{PROSE}</p><p>{PROSE}</p></div><article>{PROSE}</article><article>two</article>", f"{PROSE}\n{PROSE}"),
    (f"<article><p title='the hidden cost of it'>{PROSE}</p><p hidden>no</p><p HIDDEN=''>no</p></article>", PROSE),
    (f"<article><section id=discussion><p>{PROSE}</p></section><section class=related-work><p>Work</p></section><div class=related-posts>no</div></article>",
     f"{PROSE}\nWork"),
    ("<article><p class=notice-period>Notice</p><h2 id=copyright-law>Law</h2><div class=comments>no</div></article>", "Notice\nLaw"),
    (f"<p>{PROSE} Let <math><mi>x</mi></math> be <button>click</button>five<svg><text>no</text></svg>.</p>", f"{PROSE} Let x be five."),
])
def test_article_survives_what_pages_do(spark, html, want):
    assert "\n".join(extraction.chosen(blocks_of(html)[0], set())) == want


def test_nodes_to_remove_reach_the_pages_either_way(spark, prose, monkeypatch):
    shared = "<div class='x'>" + prose(30, 1, 99) + "</div>"
    rows = [(i, "http://h/" + str(i), f"<body>{shared}<div class='own'><p>{prose(40, 50 + i, 99)}</p></div>", 1) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    few = {r.page_id: r.text for r in extraction.main_texts(pages).collect()}
    monkeypatch.setattr(extraction, "BROADCAST_ROWS", 0)
    assert {r.page_id: r.text for r in extraction.main_texts(pages).collect()} == few == {i: prose(40, 50 + i, 99) for i in range(12)}


@pytest.mark.parametrize("n", [4_999, 5_001, 70_000, 1_000_000])
def test_text_after_long_attributes_stays(n):
    for value in ("x" * n, "y>" * (n // 2), "data:image/png;base64," + "A" * n + "==", "{'a': 'b=c', " * (n // 13)):
        for quote in '"', "'":
            value = value.replace(quote, "")
            html = f'<p>one<p data-1={quote}{value}{quote} class=x>two "2"<img src={quote}{value}{quote}>three<a href="y">four</a><p title=\'z\'>five'
            assert [b.text for b in blocks_of(html)[0]] == ["one", 'two "2"threefour', "five"]


def test_quotes_that_are_never_closed():
    far = "much text " * 3000
    for html in (f'<p title="a>one<p>{far}<p title="b">end', f"<p title=it's>one<p>{far}<p title=it's>end", f'<p title="a">one<p>{far}<p title="b>end'):
        assert [b.text for b in blocks_of(html)[0]] == ["one", far.strip(), "end"]
    for broken in ("<a b='>' ", "<a ", "<a b=\"c>", "<a b='\">", "a='", "<a " + "b" * 50):
        blocks_of(broken * 20_000)
    assert blocks_of("<p>one<a " + "b" * 1_000_000 + "='><p>two")[0][1].text == "two"


TEXTS = [
    (1, "mail a.b@c.de, or x@y.co+z@d.e", "email:5:13,email:18:24,email:24:30"),
    (2, "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "ip:3:10,ip:29:36,ip:37:44"),
    (3, "é 4111 1111 1111 1111, 4111 1111 1111 1112", "card:2:21"),
    (4, "call +1 (988) 555-2485 or +123", "phone:5:22"),
    (5, "key 4.0. v3 password=531ccd051a92ebcb68 on 2024-01-15", ""),
]


def test_base_spans_and_empty_texts(spark, frame):
    got = {r.doc_id: r for r in pii.personal_data(frame([(d, t) for d, t, _ in TEXTS] + EDGES)).collect()}
    assert {d: got[d].spans for d, _, _ in TEXTS} == {d: spans for d, _, spans in TEXTS}
    assert (got[1].n_email, got[2].n_ip, got[3].n_card, got[4].n_phone) == (3, 3, 1, 1)
    assert got[9001].spans == "" and got[9001].base_sha256 == pii.NOTHING and len(got) == len(TEXTS) + len(EDGES)
    assert pii.personal_data(frame([])).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    """The base patterns one by one, as the contract states them."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, good in kinds for m in re.finditer(pattern, text or "") if good(m)]


def test_base_spans_against_the_plain_patterns(spark, frame):
    r = random.Random(6)
    rows = []
    for d in range(4000):
        alphabet = r.choice(["0123456789.", "0123456789 -", "+0123456789 ().-", "aZ0@.-%é ", "04 -5", "0123456789.-+@ ()aZ%é\n"])
        rows.append((d, "".join(r.choice(alphabet) for _ in range(r.randrange(70)))))
    rows += [(d, "é 4111 1111 1111 1111, 4111111111111111 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 +1 (555) 010-9999 a@b.c x%y@z-z.co.uk ") for d in (5000, 5001)]
    got = pii.personal_data(frame(rows)).collect()
    assert sum(x.n_email + x.n_ip + x.n_card + x.n_phone for x in got) > 300
    for x in got:
        spans = base_spans(dict(rows)[x.doc_id])
        counts = tuple(sum(s.startswith(k + ":") for s in spans) for k in ("email", "ip", "card", "phone"))
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == counts, dict(rows)[x.doc_id]
        assert x.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(x.spans.split(","))


def test_model_adds_unseen_numbers_only(spark, frame):
    texts = [(1, "ring me (988) 555-2485 tonight"), (2, "phone 212-555-7788."), (3, "in 2019 and 2020 we had 3,500.50"), (4, "room 12 at 10:30")]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(texts)).collect()}
    assert got == {1: "phone:8:22", 2: "phone:6:18", 3: "", 4: ""}


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(3)
    model = pii.Crf(r.normal(size=(pii.WIDTH, 5)), r.normal(size=(5, 5)))
    chains = pii.Chains([list(r.integers(0, pii.WIDTH, pii.SLOTS)) for _ in range(9)], [3, 4, 1, 1])
    emit, labels = model.emissions(chains), model.decode(chains)
    for first, n in ((0, 3), (3, 4), (7, 1), (8, 1)):
        def total(path):
            return sum(emit[first + i, p] for i, p in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
        assert tuple(labels[first:first + n]) == max(itertools.product(range(5), repeat=n), key=total)


def test_gradient_is_the_slope_of_the_likelihood():
    r = np.random.default_rng(4)
    model = pii.Crf(r.normal(size=(pii.WIDTH, 5)), r.normal(size=(5, 5)))
    chains = pii.Chains([list(r.integers(0, 50, pii.SLOTS)) for _ in range(5)], [2, 3])
    gold = r.integers(0, 5, 5)

    def likelihood():
        emit, out = model.emissions(chains), 0.0
        for first, n in ((0, 2), (2, 3)):
            a = emit[first]
            out += emit[first, gold[first]]
            for i in range(first + 1, first + n):
                a = np.logaddexp.reduce(a[:, None] + model.moves, axis=0) + emit[i]
                out += model.moves[gold[i - 1], gold[i]] + emit[i, gold[i]]
            out -= np.logaddexp.reduce(a)
        return out
    slope, moved = model.gradient(chains, gold)
    f, before = chains.features[3, 0], likelihood()
    model.weights[f, 2] += 1e-6
    assert (likelihood() - before) / 1e-6 == pytest.approx(slope[f, 2], abs=1e-3)
    model.weights[f, 2] -= 1e-6
    model.moves[1, 3] += 1e-6
    assert (likelihood() - before) / 1e-6 == pytest.approx(moved[1, 3], abs=1e-3)


def test_held_out_fold(spark):
    rows = spark.range(50).select("id", labelled.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


@pytest.fixture(scope="module")
def judged(spark, frame, prose):
    r = random.Random(2)
    rows, labels = [], []
    for d in range(400):
        bad, text = d % 4 == 0, prose(r.randint(30, 120), d)
        if bad:
            text = [text.upper().replace(" ", "!! "), " | ".join(text.split()), "go go " * 60][d // 4 % 3]
        toxic = d % 4 == 1
        if toxic:
            text += " you horrid muckbeast and the muslims too"
        rows.append((d, text))
        labels.append((d, int(not bad), int(toxic)))
    return frame(rows + EDGES), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, frame, judged):
    docs, labels = judged
    got = quality.scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = [r for r in got.collect() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in rows) >= 0.95 * len(rows)
    assert got.filter("score BETWEEN 0 AND 1").count() == docs.count()
    none = quality.scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and quality.scores(frame([]), labels).count() == 0


def test_normal_equations_are_those_of_all_rows():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(40, 14)), r.integers(0, 2, 40)
    fourier = quality.Fourier(np.zeros(14), np.ones(14), 16, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y)], names=["x", "label"])
    out = list(quality._equations(fourier)(iter([batch.slice(0, 13), batch.slice(13)])))[0]
    z = fourier(x)
    assert np.allclose(quality.matrix(out.column("row")), np.c_[z.T @ z, z.T @ y])


def test_isotonic_is_rising_and_keeps_the_total():
    n, good = np.array([4.0, 2, 5, 1]), np.array([2.0, 0, 4, 1])
    fit = quality.isotonic(n, good)
    assert (np.diff(fit) >= 0).all() and (fit * n).sum() == pytest.approx(good.sum()) and fit[0] == fit[1] == pytest.approx(1 / 3)


def test_toxicity_ignores_neutral_mentions(spark, frame, judged):
    docs, labels = judged
    got = toxicity.scores(docs, labels).collect()
    rows = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 1) for r in rows) >= 0.95 * len(rows)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    fair = toxicity.fit(docs.select("doc_id", "text"), labels)
    plain = toxicity.fit(docs.select("doc_id", "text"), labels, invariance=0.0)
    mention = Texts(pa.array(["the muslims came and sang", "a horrid muckbeast", "the people came and sang"]))
    assert fair.score(mention)[0] < 0.5 < fair.score(mention)[1] and fair.score(mention)[0] < plain.score(mention)[0]
    assert fair.score(mention)[0] == pytest.approx(fair.score(mention)[2], abs=0.15)
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()}.pop() < 0.01


def test_swaps_of_long_and_repeated_terms_keep_the_score(spark, frame, judged):
    docs, labels = judged
    group = "you horrid muckbeast and the christians and christians, christians and foreigners too"
    biased = docs.withColumn("text", F.regexp_replace("text", "you horrid muckbeast and the muslims too", group))
    fair = toxicity.fit(biased.select("doc_id", "text"), labels)
    for times in (1, 2, 4):
        texts = [" ".join([f"the {term} came and sang"] * times) for term in ("christians", "foreigners", "muslims", "people", "humans")]
        score = fair.score(Texts(pa.array(texts)))
        assert np.ptp(score) < 0.02


def test_labels_of_other_documents_do_not_count(spark, frame, judged):
    docs, labels = judged
    learnt = labels.filter("toxic IS NOT NULL").limit(40).select((F.col("doc_id") + 10**9).alias("doc_id"), "toxic", "quality")
    got = toxicity.scores(docs, learnt).collect()
    assert {(r.score < 0.01, r.predicted) for r in got} == {(True, 0)}
    twice = toxicity.scores(docs.unionByName(docs.select(*[F.lit("more").alias(c) if c == "text" else c for c in docs.columns])), labels)
    assert twice.count() == 2 * docs.count()
