"""Near-duplicate documents by one-permutation MinHash, and their components.

One pass hashes every shingle once: the high bits choose one of ``BINS`` bins, the rest
compete for its minimum. Empty bins copy an occupied bin that their own sequence of
pseudorandom bins meets first (optimal densification). Some bins, at most ``ROWS``, make a band; documents
that agree in a band share a bucket. A link has a Jaccard similarity of at least ``percent``.

Copies with equal shingle sets are folded first, so a group of copies costs one row.
A bucket then proposes star-shaped edges: its first member to all others, confirmed on the
full sets. Where a bucket still spans several components, pairs across them are held against
each other too, but only those that can link: shingles that no other document in such buckets
has (counted with one aggregation) are shared with nobody, which bounds a pair's similarity.
So no pair that shares a bucket is lost, and a bucket of m alike documents costs m - 1 pairs. A
pair at the threshold s shares no bucket with probability (1 - s ** rows) ** bands; ``rows_for`` takes
the most rows that keep it within ``MISSED``: 8 and 4e-5 at s = 0.85, 6 and 3e-6 at 0.8.

Nulls, empty and blank texts have no shingles and link with nothing. Repeated rows of one
doc_id are kept as rows and count as copies. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm import words
from lendgrain.llm.frames import components, id_text, rows_of_ids, settled
from lendgrain.session import settle

BINS, ROWS, MISSED = 256, 8, 4e-5
BANDS = BINS // ROWS
EMPTY = np.uint64(2**64 - 1)
#: Where an empty bin looks, attempt by attempt.
LOOKS = np.random.default_rng(711).integers(0, BINS, (512, BINS))

SIGNATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
    ("bands", pa.list_(pa.int64()))])


def densified(signature: np.ndarray) -> np.ndarray:
    """Fill empty bins of the rows of a signature matrix, each of which has some value."""
    flat = signature.reshape(-1)
    full = flat != EMPTY
    empty = np.flatnonzero(~full)
    out = flat.copy()
    for look in LOOKS:
        if not len(empty):
            break
        source = empty // BINS * BINS + look[empty % BINS]
        hit = full[source]
        out[empty[hit]] = flat[source[hit]]
        empty = empty[~hit]
    step = 1
    while len(empty):  # so few occupied bins that no look met one: the next one upwards
        source = empty // BINS * BINS + (empty % BINS + step) % BINS
        hit = full[source]
        out[empty[hit]] = flat[source[hit]]
        empty, step = empty[~hit], step + 1
    return out.reshape(signature.shape)


def rows_for(percent: int) -> int:
    """Bins in a band, for pairs at this similarity."""
    s = percent / 100
    return next((rows for rows in range(ROWS, 1, -1) if (1 - s ** rows) ** (BINS // rows) <= MISSED), 1)


def band_keys(owner: np.ndarray, hashes: np.ndarray, n: int, rows: int = ROWS) -> np.ndarray:
    """Bucket keys of texts 0 .. n - 1 from their distinct shingle hashes, sorted by owner and hash."""
    cell = owner * BINS + (hashes >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    signature = np.full(n * BINS, EMPTY)
    signature[cell[first]] = hashes[first]
    bands = BINS // rows
    signature = densified(signature.reshape(n, BINS))[:, :bands * rows].reshape(n, bands, rows)
    key = (signature * words.PLACES[:rows]).sum(axis=2, dtype=np.uint64)
    return words.mix(key + np.arange(bands, dtype=np.uint64) * words.PLACES[9])


def fewest_linked(percent: int) -> int:
    """Smallest set size that can link with a different set: n / (n + 1) must reach the threshold."""
    return -(-percent // (100 - percent)) if percent < 100 else 2**62


def _signatures(percent: int):
    least, rows = fewest_linked(percent), rows_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in words.cuts(batches):
            n = len(texts)
            owner, hashes = words.distinct(*words.shingles(texts))
            counts = np.bincount(owner, minlength=n)
            edges = np.concatenate(([0], np.cumsum(counts)))
            place = words.mix(words.PLACES[11] * (np.arange(len(owner)) - edges[owner]).astype(np.uint64))
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64))) for v in (
                words.mix(hashes ^ words.PLACES[12]), words.mix(hashes) * place)]
            set_a, set_b = (np.diff(s[edges]).view(np.int64) for s in sums)
            large = np.flatnonzero(counts >= least)
            renumbered = np.full(n, -1)
            renumbered[large] = np.arange(len(large))
            kept = renumbered[owner] >= 0
            keys = band_keys(renumbered[owner[kept]], hashes[kept], len(large), rows).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.where(counts >= least, BINS // rows, 0)))).astype(np.int32)
            bands = pa.ListArray.from_arrays(offsets, keys.reshape(-1))
            yield words.table(SIGNATURES, doc_id=piece.column("doc_id"), n_shingles=counts, set_a=set_a,
                              set_b=set_b, bands=bands)
    return run


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(texts: words.Texts) -> list[np.ndarray]:
        owner, hashes = words.distinct(*words.shingles(texts))
        return np.split(hashes, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, right in words.cuts(batches, "text_b"):
            column = piece.column("text_a")
            same = np.ones(len(right), bool)  # rows of one centre mostly stand together
            ids = piece.column("a").to_numpy()
            same[0], same[1:] = False, ids[1:] == ids[:-1]
            lefts = iter(sets(words.Texts(column.take(pa.array(np.flatnonzero(~same))))))
            linked, one = np.zeros(len(right), bool), None
            for i, other in enumerate(sets(right)):
                one = one if same[i] else next(lefts)
                both = len(one) + len(other) - len(np.union1d(one, other))
                linked[i] = 100 * both >= percent * (len(one) + len(other) - both)
            yield pa.RecordBatch.from_arrays([piece.column(n).filter(pa.array(linked)) for n in ("a", "b")], schema=schema)
    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of doc_ids whose full shingle sets reach the threshold."""
    ids = settle(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = rows_of_ids(docs, ids, "doc_id").dropDuplicates(["doc_id"])
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest linked doc_id) and kept."""
    docs = id_text(docs)
    marked = settle(docs.mapInArrow(
        _signatures(percent), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    one_set = ["n_shingles", "set_a", "set_b"]
    sets = settled(marked.filter("n_shingles > 0").groupBy(*one_set).agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    keyed = sets.filter("id IS NOT NULL").select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    shared = keyed.groupBy("key").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1").drop("in_bucket")
    members = settled(keyed.join(shared.hint("merge"), "key"))  # exploded rows look fewer to Spark than they are
    labels = _labels(members, sets.select("id", "bands"), docs, percent)
    members_of = marked.join(sets.select(*one_set, "id"), one_set, "left").join(labels, "id", "left")
    smallest = F.coalesce("component_id", "id", "doc_id")
    return members_of.select("doc_id", "n_shingles", smallest.alias("component_id"), F.col("doc_id").eqNullSafe(smallest).alias("kept"))


def representatives(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Rows of ``docs``, with all their columns, but those of a group's other doc_ids than the smallest.

    Rows without doc_id stay, as nothing names them.
    """
    copies = settled(near_duplicates(docs, percent).filter("NOT kept").select("doc_id").distinct())
    return rows_of_ids(docs, copies, "doc_id", how="left_anti")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("shingle", pa.int64())])
    for piece, texts in words.cuts(batches):
        owner, hashes = words.distinct(*words.shingles(texts))
        yield words.table(schema, id=piece.column("doc_id").take(pa.array(owner)), shingle=hashes.view(np.int64))


def own_shingles(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, own): how many shingles of a document no other one of ``ids`` has."""
    texts = rows_of_ids(docs, ids.withColumnRenamed("id", "doc_id"), "doc_id").dropDuplicates(["doc_id"])
    holders = texts.mapInArrow(_shingle_rows, "id long, shingle long").groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    own = holders.filter("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    return ids.join(own, "id", "left").select("id", F.coalesce("own", F.lit(0)).alias("own"))


def _labels(members: DataFrame, bands: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, component_id) of the sets that link with another one."""
    first = members.filter("id = first_id").select("key", F.col("id").alias("a"), F.col("n").alias("n_a"))
    sized = (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent) & (F.col("a") != F.col("id"))
    tested = settle(members.join(first, "key").filter(sized).select("a", F.col("id").alias("b")).distinct())
    links = settled(confirmed(tested, docs, percent))
    labels = settled(components(links))

    known = members.join(labels, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
    firsts = known.filter("id = first_id").select("key", F.col("c").alias("c_first"))
    known = settle(known.join(firsts, "key"))
    mixed = settle(known.filter("c <> c_first").select("key").distinct())
    known = known.join(mixed, "key", "left_semi")
    known = settle(known.join(own_shingles(settle(known.select("id").distinct()), docs), "id").withColumn("most", F.col("n") - F.col("own")))
    known = settled(known.join(bands, "id"))
    outside = known.filter("c <> c_first").select(
        "key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"), F.col("most").alias("most_a"),
        F.col("bands").alias("bands_a"))
    shared = F.least("most", "most_a")
    possible = (F.col("c") != F.col("c_a")) & (shared * 100 >= (F.col("n") + F.col("n_a") - shared) * percent)
    one_way = (F.col("a") < F.col("id")) | (F.col("c") == F.col("c_first"))
    met = F.array_position(F.zip_with("bands", "bands_a", lambda x, y: x == y), True)  # the first bucket both are in
    first_met = met == F.array_position(F.col("bands"), F.col("key"))
    rest = outside.join(known, "key").filter(possible & one_way & first_met).select(
        F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    more = settled(confirmed(settled(rest.join(tested, ["a", "b"], "left_anti")), docs, percent))
    return labels if more.isEmpty() else settle(components(links.unionByName(more)))
