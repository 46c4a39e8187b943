"""A toxicity score by a counterfactual-regularised classifier.

Features are the words of a text and the first ``STEMS`` bytes of longer ones, by hash: whether
they occur at all, twice or more, four times or more (``OFTEN``). Those that tell the classes apart on the training sample are kept, with all identity
terms. Logistic regression is fitted with a penalty on score changes under swaps: in every
training text that mentions an identity term, each mention is swapped for other terms (a neutral
one among them) and the squared change of the logit is added to the loss: of all its features, the
word, its stems and how often they occur. So a mention of a group by itself hardly moves a score.

The sample is at most ``max_rows`` labelled rows of each class outside the held-out fold, by
smallest hash of doc_id; classes are weighted back to their sizes. Statistics and scores are
computed on whole texts. Nulls and texts without words score as the intercept. With labels of one
class, or none, every score is that share (0 if there are none). Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm import words
from lendgrain.llm.frames import id_text, small_batches
from lendgrain.llm.labelled import held_out, training_labels
from lendgrain.session import settle

STEMS, OFTEN = (5, 7), (1, 2, 4)
MAX_ROWS, MAX_FEATURES, LEAST_Z, SWAPS, THRESHOLD = 8000, 4096, 3.0, 3, 0.5

# Words that name groups of people, the neutral ones last.
IDENTITY_TERMS = [
    "women", "men", "woman", "man", "girls", "boys", "gay", "lesbian", "trans", "straight", "black", "white", "asian",
    "latino", "african", "european", "muslim", "muslims", "christian", "christians", "jew", "jews", "jewish", "hindu",
    "buddhist", "atheist", "immigrant", "immigrants", "refugee", "refugees", "foreigners", "disabled", "old", "young",
    "frauen", "männer", "muslime", "christen", "juden", "ausländer", "femmes", "hommes", "musulmans", "juifs",
    "mujeres", "hombres", "musulmanes", "judíos", "people", "person", "persons", "humans",
]
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def words_of(texts: words.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text of every word, and the hashes of the word and its stems, 0 for a stem that is not shorter."""
    starts, ends = texts.words(NOT_LETTER)
    sums = texts.running()
    hashes = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    hashes[:, 0] = texts.hashes(sums, starts, ends)
    for k, stem in enumerate(STEMS):
        longer = ends - starts > stem
        hashes[longer, 1 + k] = texts.hashes(sums, starts[longer], starts[longer] + stem) ^ words.PLACES[40 + k]
    return texts.owner(starts), hashes


def counted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct feature: words and stems that occur ``OFTEN`` times at least."""
    owner, hashes = np.tile(owner, hashes.shape[1]), hashes.T.reshape(-1)
    owner, hashes = owner[hashes != 0], hashes[hashes != 0]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(owner)))
    owner, hashes = owner[first], hashes[first]
    enough = [times >= n for n in OFTEN]
    return (np.concatenate([owner[e] for e in enough]),
            np.concatenate([hashes[e] ^ words.PLACES[50 + n] if n > 1 else hashes[e] for n, e in zip(OFTEN, enough)]))


def features(texts: words.Texts) -> tuple[np.ndarray, np.ndarray]:
    return counted(*words_of(texts))


def term_words(terms: list[str]) -> np.ndarray:
    """Hashes of each term and its stems."""
    return words_of(words.Texts(pa.array(terms)))[1]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("feature", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])
    for piece, texts in words.cuts(batches):
        owner, hashes = features(texts)
        label = piece.column("label").to_numpy()[owner]
        found, at = np.unique(hashes, return_inverse=True)
        toxic = np.bincount(at, label, len(found)).astype(int)
        yield words.table(schema, feature=found.view(np.int64), toxic=toxic, other=np.bincount(at, minlength=len(found)) - toxic)


class Lookup:
    """Places of hashes in a small sorted table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.hashes >> np.uint64(46)] = True

    def __call__(self, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        likely = self.maybe[hashes >> np.uint64(46)]
        owner, hashes = owner[likely], hashes[likely]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return owner[there], at[there]


def swapped(owner: np.ndarray, hashes: np.ndarray, terms: np.ndarray, swaps: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words of the texts with identity terms after each swap: every term for another one, and all for the last, neutral one."""
    order = np.argsort(terms[:, 0])
    at = order[np.minimum(np.searchsorted(terms[order, 0], hashes[:, 0]), len(terms) - 1)]
    mention = terms[at, 0] == hashes[:, 0]
    told = np.isin(owner, owner[mention])
    owner, hashes, term, mention = owner[told], hashes[told], at[told], mention[told]
    out = []
    for k in range(swaps):
        other = (term + 1 + k * 7) % len(terms) if k < swaps - 1 else np.full(len(term), len(terms) - 1)
        out.append((owner, np.where(mention[:, None], terms[other], hashes)))
    return out


def listed(n: int, owner: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    """Values of each of n texts as lists."""
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return [pa.ListArray.from_arrays(offsets, pa.array(v[order], pa.int64())) for v in values]


def _rows(lookup: Lookup, terms: np.ndarray, swaps: int):
    """Per text: label, places of its features, and by swap (``k``) the features that come (``by`` 1) and go (-1)."""
    names = ("at", "k", "moved", "by")
    schema = pa.schema([("label", pa.int64()), *[(name, pa.list_(pa.int64())) for name in names]])

    def run(batches):
        for piece, texts in words.cuts(batches):
            owner, hashes = words_of(texts)
            row, at = lookup(*counted(owner, hashes))
            here, n = row * len(lookup.hashes) + at, len(texts)
            changes = [np.zeros((4, 0), int)]
            for k, (some, other) in enumerate(swapped(owner, hashes, terms, swaps)):
                new_row, new_at = lookup(*counted(some, other))
                there = new_row * len(lookup.hashes) + new_at
                before = here[np.isin(row, some)]
                for pair, by in ((np.setdiff1d(there, before), 1), (np.setdiff1d(before, there), -1)):
                    changes.append(np.stack((pair // len(lookup.hashes), np.full(len(pair), k), pair % len(lookup.hashes), np.full(len(pair), by))))
            text, k, moved, by = np.concatenate(changes, axis=1)
            yield words.table(schema, label=piece.column("label").cast(pa.int64()), **dict(zip(names, [
                *listed(n, row, at), *listed(n, text, k, moved, by)])))
    return run


def sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> tuple[DataFrame, list[int]]:
    """Texts (text, label) of at most ``max_rows`` documents of each class, and how many documents each class has.

    Only labels of documents that are there count; a doc_id with several texts is one document, with its least text.
    """
    there = training_labels(labels, target).filter("label IN (0, 1)").join(docs.select("doc_id"), "doc_id", "left_semi")
    known = settle(there)
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return small_batches(texts.select("text", "label")), [sizes.get(0, 0), sizes.get(1, 0)]


def logistic(row: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int, swaps: np.ndarray,
             invariance: float, ridge: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept. ``swaps``: (counterfactual, feature, 1 or -1) for each feature that comes or goes."""
    w, bias = np.zeros(n), 0.0
    seen = np.full(n + 1, 1e-8)
    scale = weight.sum()
    for _ in range(steps):
        logit = np.bincount(row, w[at], len(label)) + bias
        miss = weight * (1 / (1 + np.exp(-logit)) - label) / scale
        slope = np.bincount(at, miss[row], n) + ridge * w
        if len(swaps):
            text, moved, by = swaps.T
            change = np.bincount(text, by * w[moved])
            slope += np.bincount(moved, invariance * 2 * by * change[text] / len(change), n)
        whole = np.append(slope, miss.sum())
        seen += whole ** 2
        step = 0.5 * whole / np.sqrt(seen)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


class Model:
    def __init__(self, lookup: Lookup, weights: np.ndarray, bias: float):
        self.lookup, self.weights, self.bias = lookup, weights, bias

    def score(self, texts: words.Texts) -> np.ndarray:
        owner, at = self.lookup(*features(texts))
        return 1 / (1 + np.exp(-np.clip(np.bincount(owner, self.weights[at], len(texts)) + self.bias, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = MAX_ROWS, invariance: float = 1.0,
        ridge: float = 1e-4) -> Model:
    term_features = term_words(IDENTITY_TERMS)
    terms = term_features[:, 0]
    rows, sizes = sample(docs, labels, target, max_rows)
    if 0 in sizes:
        share = 0.0 if not sum(sizes) else sizes[1] / sum(sizes)
        return Model(Lookup(terms), np.zeros(len(terms)), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    n_other, n_toxic = (min(s, max_rows) for s in sizes)
    counts = rows.mapInArrow(_counts, "feature long, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = [F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5)) for c, n in (("toxic", n_toxic), ("other", n_other))]
    z = F.abs(odds[0] - odds[1]) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    told = counts.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature")
    kept = np.array([r[0] for r in told.collect()], np.int64).view(np.uint64)
    lookup = Lookup(np.unique(np.concatenate((kept, terms))))
    taken = rows.mapInArrow(
        _rows(lookup, term_features, SWAPS),
        "label long, at array<long>, k array<long>, moved array<long>, by array<long>").toPandas()

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = list(taken[name])
        return (np.repeat(np.arange(len(lists)), [len(x) for x in lists]),
                np.concatenate([np.asarray(x, int) for x in lists]) if len(lists) else np.zeros(0, int))
    label, (row, at), (text, k) = taken["label"].to_numpy(), flat("at"), flat("k")
    weight = np.where(label == 1, sizes[1] / n_toxic, sizes[0] / n_other)
    which = np.unique(text * SWAPS + k, return_inverse=True)[1]
    swaps = np.stack((which, flat("moved")[1], flat("by")[1]), axis=1)
    return Model(lookup, *logistic(row, at, label, weight, len(lookup.hashes), swaps, invariance, ridge))


def scores(docs: DataFrame, labels: DataFrame, target: str = "toxic", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from ``THRESHOLD`` on)."""
    docs = id_text(docs)
    model = fit(docs, labels, target, **options)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for piece, texts in words.cuts(batches):
            yield words.table(schema, doc_id=piece.column("doc_id"), score=model.score(texts))
    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
