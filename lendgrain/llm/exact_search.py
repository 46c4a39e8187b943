"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights: a component's place is its term. Queries and candidates
are dealt over a grid of cells: a group of at most ``QUERY_GROUP`` queries against a share of the
candidates. In a cell, candidates stream by in blocks; a block is inverted into postings (term ->
rows and weights), each term of each query scatters its weighted postings into dense score arrays,
a partition selects the block's best, and they are merged into the cell's best so far. What leaves a
cell is k rows per query; a ranking per query merges the cells.

The number of candidate shares follows the cores, not the data, until a share passes
``SHARE`` rows; so what cells hand on grows with the queries alone, and a candidate travels once per
group of queries. Memory per task: one group of queries with their best, one block.

Null vectors, and vectors with null or non-finite components, take no part, nor do rows without an
id. Weights beyond +-2 ** 24 count as that, so that scores fit in 64 bits. Of several query rows with
one id the one with the smallest vector asks; candidate rows are all listed, but never under their own
id. Shorter vectors lack the later terms. Ties go to the smaller id. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_GROUP, SHARE, BLOCK, ABREAST = 32_768, 4_000_000, 8_192, 64
LARGEST = 1 << 24


def weighted(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, weights): floor(scale * component) of every usable vector."""
    parts = F.col(vector_column).cast("array<double>")
    usable = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    weight = lambda x: F.least(F.greatest(F.floor(x * float(scale)).cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    rows = vectors.filter(F.col(id_column).isNotNull() & parts.isNotNull() & usable)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(parts, lambda x: weight(x).cast("int")).alias("weights"))


class Sparse:
    """Rows of weights as (row, term, weight) triples without zeros, ordered by term."""

    def __init__(self, ids: np.ndarray, lists: pa.ListArray):
        self.ids = ids
        lengths = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(ids)), lengths)
        term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        held = np.flatnonzero(values)
        held = held[np.argsort(term[held], kind="stable")]
        self.rows, self.terms, self.weights = row[held], term[held], values[held]
        self.most = int(np.abs(self.weights.astype(np.int64)).max(initial=0))
        self.n_terms = int(self.terms[-1]) + 1 if len(held) else 0
        self.starts = np.searchsorted(self.terms, np.arange(self.n_terms + 1))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.starts[term], self.starts[term + 1]
        return self.rows[low:high], self.weights[low:high]


class Best:
    """The k best candidates so far of every query of a group."""

    def __init__(self, queries: Sparse, k: int):
        self.queries, self.k = queries, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)
        order = np.argsort(queries.rows, kind="stable")  # back to rows, for a slice of queries at a time
        self.rows, self.terms, self.weights = queries.rows[order], queries.terms[order], queries.weights[order]
        self.by_id = np.argsort(queries.ids, kind="stable")

    def meet(self, block: Sparse) -> None:
        terms = min(self.queries.n_terms, block.n_terms)
        small = self.queries.most * block.most * max(terms, 1) < 1 << 31
        kind = np.int32 if small else np.int64
        own = np.searchsorted(self.queries.ids[self.by_id], block.ids)
        own_of = np.full(len(block.ids), -1)
        inside = own < len(self.by_id)
        same = self.queries.ids[self.by_id[own[inside]]] == block.ids[inside]
        own_of[np.flatnonzero(inside)[same]] = self.by_id[own[inside]][same]
        for low in range(0, len(self.found), ABREAST):
            high = min(low + ABREAST, len(self.found))
            scores = self.accumulated(block, low, high, terms, kind)
            lowest = np.iinfo(kind).min
            mine = np.flatnonzero((own_of >= low) & (own_of < high))
            scores[mine, own_of[mine] - low] = lowest
            self.select(np.ascontiguousarray(scores.T), block.ids, low, lowest)

    def accumulated(self, block: Sparse, low: int, high: int, terms: int, kind) -> np.ndarray:
        """Scores [candidate, query]: per term, its postings times the queries' weights are added at the postings' rows."""
        scores = np.zeros((len(block.ids), high - low), kind)
        part = slice(*np.searchsorted(self.rows, (low, high)))
        asked = np.zeros((terms, high - low), kind)
        known = self.terms[part] < terms
        asked[self.terms[part][known], self.rows[part][known] - low] = self.weights[part][known]
        for term in np.flatnonzero(asked.any(axis=1)):
            rows, weights = block.postings(term)
            share = weights.astype(kind)[:, None] * asked[term]
            if len(rows) == len(scores):
                scores += share
            else:
                scores[rows] += share
        return scores

    def select(self, scores: np.ndarray, ids: np.ndarray, low: int, lowest: int) -> None:
        k, n = self.k, scores.shape[1]
        least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), lowest, scores.dtype)
        for j in range(len(scores)):
            old_scores, old_ids = self.found[low + j]
            floor = max(least[j], old_scores[-1]) if len(old_scores) == k else least[j]
            at = np.flatnonzero((scores[j] >= floor) & (scores[j] > lowest))
            if len(at):
                new_scores, new_ids = np.concatenate((old_scores, scores[j][at])), np.concatenate((old_ids, ids[at]))
                order = np.lexsort((new_ids, -new_scores))[:k]
                self.found[low + j] = new_scores[order], new_ids[order]


def _cells(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def rows_of(best: Best) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(best.found), 4096):
            part = best.found[low:low + 4096]
            owners = np.repeat(best.queries.ids[low:low + 4096], [len(s) for s, _ in part])
            yield pa.RecordBatch.from_arrays([
                pa.array(owners), pa.array(np.concatenate([i for _, i in part])), pa.array(np.concatenate([s for s, _ in part]))], schema=schema)

    def sparse(pieces: list[pa.RecordBatch]) -> Sparse:
        table = pa.Table.from_batches(pieces).combine_chunks()
        lists = table.column("weights").combine_chunks()
        return Sparse(table.column("id").to_numpy(), lists if isinstance(lists, pa.ListArray) else lists.cast(pa.list_(pa.int32())))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        """Stretches of one cell and kind; rows come in that order."""
        for batch in batches:
            key = batch.column("cell").to_numpy() * 2 + batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for low, high in zip(edges, edges[1:]):
                if high > low:
                    yield int(key[low] // 2), int(key[low] % 2), batch.slice(low, high - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, waiting, best = None, [], [], None

        def met() -> None:
            nonlocal best
            if asked and best is None:
                best = Best(sparse(asked), k)
            if best is not None and waiting:
                best.meet(sparse(waiting))
            waiting.clear()

        for at, kind, piece in pieces(batches):
            if at != cell:
                met()
                if best is not None:
                    yield from rows_of(best)
                cell, best = at, None
                asked.clear()
            if kind == 0:
                asked.append(piece)
                continue
            while piece.num_rows:
                room = BLOCK - sum(p.num_rows for p in waiting)
                waiting.append(piece.slice(0, room))
                piece = piece.slice(room)
                if len(waiting) and sum(p.num_rows for p in waiting) == BLOCK:
                    met()
        met()
        if best is not None:
            yield from rows_of(best)
    return run


def top_matches(
        vectors: DataFrame, asks: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64,
        query_group: int = QUERY_GROUP, shares: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): per row for which ``asks`` holds, the k other rows of largest inner product."""
    spark = vectors.sparkSession
    candidates = weighted(vectors, id_column, vector_column, scale)
    queries = weighted(vectors.filter(asks), id_column, vector_column, scale).groupBy("id").agg(F.min("weights").alias("weights"))
    groups = max(1, math.ceil(vectors.filter(asks).count() / query_group))
    if shares is None:
        cores = spark.sparkContext.defaultParallelism
        shares = max(math.ceil(2 * cores / groups), math.ceil(vectors.count() / SHARE))
    cell = lambda group, share: (group * shares + share).cast("int").alias("cell")
    some = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("id", "weights", some(groups).alias("own"), every(shares).alias("all")).select(
        cell(F.col("own"), F.col("all")), F.lit(0).alias("kind"), "id", "weights")
    met = candidates.select("id", "weights", some(shares).alias("own"), every(groups).alias("all")).select(
        cell(F.col("all"), F.col("own")), F.lit(1).alias("kind"), "id", "weights")
    dealt = asked.unionByName(met).repartitionById(groups * shares, "cell").sortWithinPartitions("cell", "kind")
    best = dealt.mapInArrow(_cells(k), "query_id long, vec_id long, score long")
    return best.selectExpr(
        "query_id", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank", "vec_id", "score").filter(F.col("rank") <= k)
