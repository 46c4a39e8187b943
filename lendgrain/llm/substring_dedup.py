"""Exact removal of repeated byte strings across documents, by refining buckets of anchors.

A byte goes if some ``LENGTH``-byte string over it also starts earlier: in a document with a
smaller doc_id, or earlier in the same one. Sorting every suffix is not needed for that, as only
buckets that still hold several members matter, and each is refined by later offsets:

1. Every window of ``LENGTH`` bytes is led by the smallest ``Q``-gram hash in it (the leftmost
   of equals). Windows led by the same occurrence form a stretch; its Q-gram is the first bucket.
2. A bucket is refined by an identifier of the stretch's whole surroundings. All but the
   earliest stretch of a refined bucket are repeats. Buckets with one stretch are done.
3. Stretches left in a bucket are refined window by window: identifiers of 25 bytes at offsets
   0 and 25 give those of 50, and these, at 0 and 50, give those of 100. All but the earliest
   window of such a bucket are repeats.

Equal windows have equal leaders, and the earliest of them lies in a stretch that step 2 keeps,
so no repeat is missed. Repeats within one cut of a task are settled before the shuffle, so a
passage that a third of all documents share costs a row per cut. Buckets are read as sorted
streams, never held. Identifiers have 64 bits.

Null and empty texts have no bytes. A row without doc_id is returned whole and nobody's source.
Rows that repeat a doc_id are copies of one document: each is cut at the spans of that doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm import words
from lendgrain.llm.frames import id_text, rows_of_ids, settled
from lendgrain.session import settle

LENGTH, Q = 100, 40
LED = LENGTH - Q + 1
SEGMENT, PLACE_BITS = 1 << 22, 23
RAW = words._random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

BUCKETED = pa.schema([("bucket", pa.int64()), ("refined", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int64())])
SPANS = pa.schema([("doc_id", pa.int64()), ("span", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("kept_sha256", pa.string()), ("kept", pa.binary())])

# A span is one long: first window, number of windows, and whether it is a repeat.
pack = lambda start, count, repeat: start << 16 | count << 1 | repeat
unpack = lambda span: (span >> 16, (span & 0xFFFF) >> 1)


def _sums(texts: words.Texts) -> np.ndarray:
    sums = np.zeros(len(texts.data) + 1, np.uint64)
    np.cumsum(RAW[texts.data] * words.powers(words.BASE, len(texts.data)), out=sums[1:])
    return sums


def _grams(sums: np.ndarray, q: int) -> np.ndarray:
    return words.mix((sums[q:] - sums[:-q]) * words.powers(words.UNBASE, len(sums))[:len(sums) - q])


def leaders(grams: np.ndarray) -> np.ndarray:
    """Place of the leading gram of every window."""
    n = len(grams) - LED + 1
    out = np.empty(n, np.int64)
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    for a in range(0, n, SEGMENT):
        b = min(n, a + SEGMENT)
        least = (grams[a:b + LED - 1] & ~low_bits) | np.arange(b - a + LED - 1, dtype=np.uint64)
        width = 1
        while width < LED:
            step = min(width, LED - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        out[a:b] = (least & low_bits).astype(np.int64) + a
    return out


def _bucketed(bucket, refined, doc, start, count) -> pa.RecordBatch:
    """Rows for the shuffle; repeats within the cut are marked and scattered by document."""
    order = np.lexsort((start, doc, refined, bucket))
    bucket, refined, doc, start, count = (x[order] for x in (bucket, refined, doc, start, count))
    same = np.zeros(len(bucket), bool)
    same[1:] = (bucket[1:] == bucket[:-1]) & (refined[1:] == refined[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(bucket))))
    repeat = same & ((doc != doc[first]) | (start != start[first]))
    bucket = np.where(repeat, words.mix(doc.view(np.uint64)).view(np.int64), bucket.view(np.int64))
    return words.table(BUCKETED, bucket=bucket, refined=refined.view(np.int64), doc_id=doc,
                       span=pack(start, count, repeat.astype(np.int64)))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in words.cuts(batches):
        if len(texts.data) < LENGTH:
            continue
        sums = _sums(texts)
        grams = _grams(sums, Q)
        led_by = leaders(grams)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.edges))
        window = np.flatnonzero(owner[:len(led_by)] == owner[LENGTH - 1:])
        if not len(window):
            continue
        leader = led_by[window]
        new = np.ones(len(window), bool)
        new[1:] = leader[1:] != leader[:-1]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(window)))
        start, leader = window[at], leader[at]
        around = words.Texts.hashes(sums, start, start + count - 1 + LENGTH)
        refined = words.mix(around + count.astype(np.uint64) * words.PLACES[30] + (leader - start).astype(np.uint64) * words.PLACES[31])
        owner = owner[start]
        yield _bucketed(grams[leader], refined, piece.column("doc_id").to_numpy()[owner], start - texts.edges[owner], count)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in words.cuts(batches):
        sums = _sums(texts)
        lists = piece.column("spans")
        spans = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        start, count = unpack(spans)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner = np.repeat(owner, count)
        start = np.repeat(start, count) + within
        fits = start + LENGTH <= np.diff(texts.edges)[owner]
        owner, start = owner[fits], start[fits]
        at = start + texts.edges[owner]
        b25 = _grams(sums, 25)
        b50 = words.mix(b25[:-25] * words.PLACES[32] + b25[25:] * words.PLACES[33])
        b100 = words.mix(b50[at] * words.PLACES[34] + b50[at + 50] * words.PLACES[35])
        yield _bucketed(b100, np.zeros(len(at), np.uint64), piece.column("doc_id").to_numpy()[owner], start, np.ones(len(at), np.int64))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket, refined, doc_id and span: repeats, and stretches that share a bucket.

    Holds one row of state between batches: the last row, and the last first-of-its-kind.
    """
    last, last_repeat, waiting, waiting_shares = None, False, None, False
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        marked = (rows[:, 3] & 1) == 1
        done, rows = rows[marked], rows[~marked]
        if not len(rows):
            yield words.table(SPANS, doc_id=done[:, 2], span=done[:, 3])
            continue
        before = np.concatenate((rows[:1] if last is None else last[None], rows[:-1]))
        same = (rows[:, :2] == before[:, :2]).all(axis=1)
        again = same & (rows[:, 2:] == before[:, 2:]).all(axis=1)
        if last is None:
            same[0] = again[0] = False
        repeat = same.copy()
        source = np.maximum.accumulate(np.where(again, -1, np.arange(len(rows))))
        repeat[again] = np.where(source[again] < 0, last_repeat, same[np.maximum(source[again], 0)])
        last, last_repeat = rows[-1], bool(repeat[-1])
        firsts = rows[~same]
        if waiting is not None:
            firsts = np.concatenate((waiting[None], firsts))
        shares = np.zeros(len(firsts), bool)
        if len(firsts):
            shares[1:] = firsts[1:, 0] == firsts[:-1, 0]
            shares[:-1] |= shares[1:]
            shares[0] |= waiting_shares
            waiting, waiting_shares = firsts[-1], bool(shares[-1])
            firsts, shares = firsts[:-1], shares[:-1]
        found = np.concatenate((done, rows[repeat] | np.array([0, 0, 0, 1]), firsts[shares]))
        yield words.table(SPANS, doc_id=found[:, 2], span=found[:, 3])
    if waiting is not None and waiting_shares:
        yield words.table(SPANS, doc_id=waiting[2:3], span=waiting[3:4])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in words.cuts(batches):
        lists = piece.column("spans")
        spans, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        removed, runs, digests, kept = [], [], [], []
        for i, end in enumerate(ends):
            data = texts.data[texts.edges[i]:texts.edges[i + 1]]
            start, count = unpack(spans[ends[i - 1] if i else 0:end])
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, np.minimum(start, len(data)), 1)
            np.add.at(depth, np.minimum(start + count - 1 + LENGTH, len(data)), -1)
            gone = np.cumsum(depth[:-1]) > 0
            rest = data[~gone].tobytes()
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield words.table(OUT, doc_id=piece.column("doc_id"), n_bytes=np.diff(texts.edges), n_removed=removed,
                          n_spans=runs, kept_sha256=digests, kept=pa.array(kept, pa.binary()))


def _refine(rows: DataFrame) -> DataFrame:
    order = ["bucket", "refined", "doc_id", "span"]
    return rows.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_settled, "doc_id long, span long")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, span): stretches of windows that start earlier elsewhere; several may overlap."""
    docs = docs.filter("doc_id IS NOT NULL")
    columns = "bucket long, refined long, doc_id long, span long"
    first = settled(_refine(docs.mapInArrow(_stretches, columns)))
    shared = settle(first.filter("span & 1 = 0").groupBy("doc_id").agg(F.collect_list("span").alias("spans")))
    texts = rows_of_ids(docs, shared.select("doc_id"), "doc_id")
    windows = texts.join(shared, "doc_id").select("doc_id", "text", "spans").mapInArrow(_windows, columns)
    return first.unionByName(_refine(windows)).filter("span & 1 = 1")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    docs = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    spans = settled(repeats(docs).groupBy("doc_id").agg(F.collect_list("span").alias("spans")))
    ids = spans.select("doc_id")
    few = rows_of_ids(docs, ids, "doc_id")
    cut = few.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    zero = F.lit(0).cast("long")
    whole = rows_of_ids(docs, ids, "doc_id", how="left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return whole.unionByName(cut)
