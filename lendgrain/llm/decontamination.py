"""Benchmark passages in documents: SimHash of item-sized windows, then an exact check.

A document window as long as a benchmark item (in words, or the whole document if shorter) is
fingerprinted wherever one of the item's five-word shingles puts the item's first word. Windows
without any such shingle have similarity 0, so none of them is missed. A fingerprint is the
64-bit SimHash of the window's shingles, each weighted with the bytes of its words. Fingerprints
are looked up in an index of the items' fingerprints by eight 8-bit blocks: two fingerprints
within ``RADIUS`` bits differ by at most ``RADIUS // 8`` bits in one block at least, so every
item within the radius is found. Candidates are checked exactly: the weighted Dice similarity of
the distinct shingles, 2 * w(shared) / (w(item) + w(window)), must reach ``similarity``.

Items are read in blocks of ``BLOCK_ITEMS``; each block visits all documents once, so what is
sent to executors is bounded whatever the benchmark's size, and documents are never shuffled.
Nulls are empty texts. Items or documents with fewer than five words have no shingle and match
nothing. Repeated rows give repeated results; an empty benchmark gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lendgrain.llm import words
from lendgrain.llm.frames import id_text, small_batches

BLOCKS, RADIUS, BLOCK_ITEMS = 8, 23, 4096
BLOCK_BYTES = 8_000_000
MATCHES = "doc_id long, item_id long, start_word long, n_words long, similarity double"
LOW_BITS = np.array([[(value ^ other).bit_count() <= RADIUS // BLOCKS for other in range(256)] for value in range(256)])


def fingerprints(hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of stretches of shingles, each of at least one."""
    out = np.zeros(len(begin), np.uint64)
    for low in range(0, len(begin), 2000):
        b, n = begin[low:low + 2000], sizes[low:low + 2000]
        first = np.cumsum(n) - n
        at = np.repeat(b - first, n) + np.arange(n.sum())
        bits = np.unpackbits(hashes[at].view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        votes = np.add.reduceat((2 * bits - 1) * weights[at, None], first, axis=0)
        out[low:low + 2000] = np.packbits(votes > 0, axis=1).reshape(-1, 8).view(np.uint64).ravel()
    return out


class Shingled:
    """Words of some texts and their five-word shingles, with weights."""

    def __init__(self, texts: words.Texts):
        starts, ends = texts.words()
        owner = texts.owner(starts)
        self.hashes, self.first = words.sequences(words.hashes_of_words(texts, starts, ends)[:, 0], owner, words.SHINGLE)
        sizes = np.concatenate(([0], np.cumsum(ends - starts)))
        self.weights = sizes[self.first + words.SHINGLE] - sizes[self.first]
        self.owner = owner[self.first]
        self.words = np.bincount(owner, minlength=len(texts))
        self.shingles = np.bincount(self.owner, minlength=len(texts))
        self.begin = np.cumsum(self.shingles) - self.shingles


class Items:
    """A block of benchmark items: shingle table, fingerprints and their block index."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        s = Shingled(words.Texts(pa.array(texts, pa.string())))
        self.ids, self.sizes = ids, s.words
        self.offset = np.arange(len(s.hashes)) - s.begin[s.owner]
        order = np.argsort(s.hashes, kind="stable")
        self.hashes, self.owner, self.offset = s.hashes[order], s.owner[order], self.offset[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[s.hashes >> np.uint64(44)] = True
        whole = np.flatnonzero(s.shingles > 0)
        self.prints = np.zeros(len(texts), np.uint64)
        self.prints[whole] = fingerprints(s.hashes, s.weights, s.begin[whole], s.shingles[whole])
        self.near = np.zeros((BLOCKS, 256, len(texts)), bool)
        for block, values in enumerate(self.prints.view(np.uint8).reshape(-1, BLOCKS).T):
            self.near[block] = LOW_BITS[:, values]
        self.near[:, :, s.shingles == 0] = False
        owner, keys, weights = _distinct_weighted(s.owner, s.hashes, s.weights)
        self.total = np.bincount(owner, weights, len(texts))
        self.keys = np.sort(_pair_keys(owner, keys))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) whose fingerprints differ by at most RADIUS bits."""
        found = []
        step = max(1, 8_000_000 // max(1, len(self.ids)))
        for low in range(0, len(prints), step):
            some = prints[low:low + step]
            hit = np.zeros((len(some), len(self.ids)), bool)
            for block, values in enumerate(some.view(np.uint8).reshape(-1, BLOCKS).T):
                hit |= self.near[block][values]
            window, item = np.nonzero(hit)
            good = np.bitwise_count(some[window] ^ self.prints[item]) <= RADIUS
            found.append((window[good] + low, item[good]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _distinct_weighted(owner, hashes, weights):
    order = np.lexsort((hashes, owner))
    owner, hashes, weights = owner[order], hashes[order], weights[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new], weights[new]


def _pair_keys(item: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return words.mix(hashes + item.astype(np.uint64) * words.PLACES[20])


def matches(texts: words.Texts, items: Items, similarity: float) -> tuple[np.ndarray, ...]:
    """Text, item, first word, words and similarity of the best window of every matching text and item."""
    s = Shingled(texts)
    hit = np.flatnonzero(items.maybe[s.hashes >> np.uint64(44)])
    low = np.searchsorted(items.hashes, s.hashes[hit], "left")
    n = np.searchsorted(items.hashes, s.hashes[hit], "right") - low
    hit, at = np.repeat(hit, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    none = (np.zeros(0, int),) * 4 + (np.zeros(0),)
    if not len(hit):
        return none
    owner, item = s.owner[hit], items.owner[at]
    place = hit - s.begin[owner]
    start = np.maximum(0, np.minimum(place - items.offset[at], s.words[owner] - items.sizes[item]))
    size = np.minimum(items.sizes[item], s.words[owner])
    windows = np.unique(np.stack((owner, start, size)), axis=1)
    owner, start, size = windows
    begin, count = s.begin[owner] + start, size - words.SHINGLE + 1
    window, item = items.within(fingerprints(s.hashes, s.weights, begin, count))
    if not len(window):
        return none
    used = np.unique(window)
    first = np.cumsum(count[used]) - count[used]
    at = np.repeat(begin[used] - first, count[used]) + np.arange(count[used].sum())
    w_owner, w_hash, w_weight = _distinct_weighted(np.repeat(used, count[used]), s.hashes[at], s.weights[at])
    total = np.bincount(w_owner, w_weight, len(owner))
    w_count = np.bincount(w_owner, minlength=len(owner))
    w_begin = np.cumsum(w_count) - w_count
    shared = np.zeros(len(window))
    for low in range(0, len(window), 20_000):
        a, i = window[low:low + 20_000], item[low:low + 20_000]
        n = w_count[a]
        at = np.repeat(w_begin[a] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys = _pair_keys(np.repeat(i, n), w_hash[at])
        there = items.keys[np.minimum(np.searchsorted(items.keys, keys), len(items.keys) - 1)] == keys
        shared[low:low + 20_000] = np.bincount(np.repeat(np.arange(len(a)), n), w_weight[at] * there, len(a))
    score = 2 * shared / (total[window] + items.total[item])
    good = np.flatnonzero(score >= similarity)
    window, item, score = window[good], item[good], score[good]
    order = np.lexsort((start[window], -score, item, owner[window]))
    window, item, score = window[order], item[order], score[order]
    best = np.ones(len(order), bool)
    best[1:] = (owner[window][1:] != owner[window][:-1]) | (item[1:] != item[:-1])
    window, item, score = window[best], item[best], score[best]
    return owner[window], item, start[window], size[window], score


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, each in turn on the driver."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1] or "")
        if len(ids) == BLOCK_ITEMS or held > BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per document and benchmark item found in it, at the item's best window."""
    docs = id_text(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()),
                        ("n_words", pa.int64()), ("similarity", pa.float64())])

    def finder(items: Items) -> Callable:
        def run(batches):
            for piece, texts in words.cuts(batches):
                owner, item, start, size, score = matches(texts, items, similarity)
                yield words.table(
                    schema, doc_id=piece.column("doc_id").take(pa.array(owner)),
                    item_id=pa.array([items.ids[i] for i in item], pa.int64()),
                    start_word=start, n_words=size, similarity=score)
        return run

    found = docs.sparkSession.createDataFrame([], MATCHES)
    for items in item_blocks(benchmark):
        found = found.unionByName(docs.mapInArrow(finder(items), MATCHES))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with all their columns, read once per block of items."""
    def keeper(items: Items) -> Callable:
        def run(batches):
            for piece, texts in words.cuts(batches):
                clean = np.ones(len(texts), bool)
                clean[matches(texts, items, similarity)[0]] = False
                yield piece.filter(pa.array(clean))
        return run

    kept = small_batches(docs)
    for items in item_blocks(benchmark):
        kept = kept.mapInArrow(keeper(items), docs.schema)
    return kept
