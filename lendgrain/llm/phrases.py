"""Collocations: phrases whose words stand together more often than apart, by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words.
Words are hashed first; polynomials over the word hashes, as running sums, give the two 64-bit
fingerprints of every run of words by one subtraction and one multiplication each. Runs are counted per cut, then in a shuffle that aggregates fingerprints (not
texts), each with a pointer to one occurrence: a key of the text, and the place in it. The empty run
stands before every word, so its count is the number of words of a language.

A run can only be frequent if the shorter runs in it are: words come first, then pairs of frequent
words, then runs of three and more whose pairs are all frequent. What is frequent is handed to the
tasks as a bit map of fixed size, which may let more through but drops nothing.

Frequent fingerprints are then verified against the texts their pointers name: only texts with
pointers are read again, the words at the place are hashed anew and must give both fingerprints, and
only these phrases become text. From there on everything is joined by the phrases themselves.
Two runs are taken for one only if both fingerprints agree. Counts are whole: nothing is sampled or cut off.

Null and empty texts have no words, null langs count as ``und``. Repeated rows count again and share
their pointers. Very long texts are cuts of their own. Ties are settled by the stated order. An
empty table gives no rows. Other columns are not read. Bytes between U+0000 and U+001F that neither
end a piece nor separate words belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.frames import rows_of_ids, small_batches
from lendgrain.llm.words import LOWER, Texts, cuts, hashes_of_words, mix, powers
from lendgrain.session import settle

MIN_COUNT, MAX_WORDS, INSIDE_PERCENT, PER_LANG = 30, 4, 80, 2000
MAP_BITS = 27
LEAST_POWERS = 18  # words of a cut, as a power of two

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = ENDS.copy()
BETWEEN[[0x20, 0x09]] = True
# Both congruent to 3 modulo 4, so that exchanged words keep their fingerprints apart.
BASES = (0x9E3779B97F4A7C17, 0xD1342543DE82EF97)
UNBASES = tuple(pow(b, -1, 2**64) for b in BASES)


def lang_hash(lang: str) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest("lang:" + lang)
    return value & (1 << 64) - 1, value >> 64


class Runs:
    """Fingerprints of all runs of words of some texts."""

    def __init__(self, texts: Texts, langs: list[str]):
        self.starts, self.ends = texts.words(BETWEEN)
        self.owner = texts.owner(self.starts)
        hashed = hashes_of_words(texts, self.starts, self.ends)
        self.sums = []
        for side, base in enumerate(BASES):
            sums = np.zeros(len(hashed) + 1, np.uint64)
            np.cumsum(hashed[:, side] * powers(base, len(hashed), LEAST_POWERS), out=sums[1:])
            self.sums.append(sums)
        # Pieces are numbered through all texts: runs lie in one piece if their ends do.
        self.piece = np.concatenate(([0], np.cumsum(ENDS[texts.data])))[self.starts] + self.owner
        self.langs = np.array([lang_hash(x) for x in langs], np.uint64).reshape(-1, 2)

    def first(self, size: int) -> np.ndarray:
        """First words of the runs of that many words that lie in one piece."""
        n = len(self.starts) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1:]) if n > 0 else np.zeros(0, np.int64)

    def fingerprints(self, at: np.ndarray, size: int, side: int) -> np.ndarray:
        sums, back = self.sums[side], powers(UNBASES[side], len(self.sums[side]), LEAST_POWERS)
        return finished((sums[at + size] - sums[at]) * back[at], self.langs[self.owner[at], side], size)


def finished(total, lang, size: int):
    return mix(total + mix(lang + np.uint64(size)))


def allowed(runs: Runs, at: np.ndarray, size: int, inner: int, bits: np.ndarray | None) -> np.ndarray:
    """Runs of which all inner runs of ``inner`` words are marked in the bit map."""
    if bits is None or not size:
        return at
    marked = np.zeros(len(runs.starts) + 1, bool)
    shorter = runs.first(inner)
    place = runs.fingerprints(shorter, inner, 0) >> np.uint64(64 - (8 * len(bits) - 1).bit_length())
    marked[shorter] = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
    whole = np.ones(len(at), bool)
    for k in range(size - inner + 1):
        whole &= marked[at + k]
    return at[whole]


def _counted(sizes: tuple[int, ...], inner: int, shared):
    schema = pa.schema([("size", pa.int32()), *((name, pa.int64()) for name in ("fp", "check", "n", "key", "place"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.frombuffer(shared.value, np.uint8)
        for piece, texts in cuts(batches):
            runs, keys = Runs(texts, piece.column("lang").to_pylist()), piece.column("key").to_numpy()
            for size in sizes:
                at = allowed(runs, runs.first(size) if size else np.arange(len(runs.starts)), size, inner, bits)
                fp, check = runs.fingerprints(at, size, 0), runs.fingerprints(at, size, 1)
                order = np.argsort(fp)
                at, fp, check = at[order], fp[order], check[order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])
                begin = np.flatnonzero(new)
                n, at = np.diff(np.append(begin, len(fp))), at[begin]
                owner = runs.owner[at]
                columns = fp[begin].astype(np.int64), check[begin].astype(np.int64), n, keys[owner], runs.starts[at] - texts.edges[owner]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), *map(pa.array, columns)], schema=schema)
    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases at the pointers of each text, if the words there have both fingerprints."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])
    for piece, texts in cuts(batches):
        langs, lists = piece.column("lang").to_pylist(), piece.column("pointers")
        runs, found = Runs(texts, langs), lists.flatten()
        size, place, fp, check, n = (found.field(name).to_numpy(zero_copy_only=False) for name in ("size", "place", "fp", "check", "n"))
        text_of = np.repeat(np.arange(len(langs)), np.diff(lists.offsets.to_numpy()))
        at = np.searchsorted(runs.starts, place + texts.edges[text_of])
        data, rows = LOWER[texts.data].tobytes(), []
        for k in np.unique(size):
            here = np.flatnonzero((size == k) & (at < len(runs.starts)) & (at + k <= len(runs.starts)))
            same = runs.fingerprints(at[here], int(k), 0).astype(np.int64) == fp[here]
            same &= runs.fingerprints(at[here], int(k), 1).astype(np.int64) == check[here]
            for i in here[same]:
                words = [data[runs.starts[w]:runs.ends[w]] for w in range(at[i], at[i] + k)]
                rows.append((langs[text_of[i]], b" ".join(words).decode(), int(k), int(n[i])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)], schema=schema)


def bit_map(frequent: DataFrame, size: int):
    """Fixed-size map of the fingerprints of frequent runs of one size, for all tasks."""
    bit = F.shiftrightunsigned("fp", 64 - MAP_BITS) + 1
    rows = frequent.filter(F.col("size") == size).select(bit.alias("bit")).groupBy(
        F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = bytearray(1 << MAP_BITS - 3)
    for row in rows.collect():  # 16 MB at most
        low = (row.bucket - 1) * len(row.bits)
        whole[low:low + len(row.bits)] = row.bits
    return frequent.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, size, n) of all phrases of 1 to ``max_words`` words with ``min_count`` occurrences, and of the empty one."""
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = small_batches(docs.select(lang.alias("lang"), text.alias("text"), F.xxhash64(lang, text).alias("key")))
    levels, shared = [], None
    for sizes in ((0, 1), (2,), tuple(range(3, max_words + 1))):
        if sizes and sizes[0] <= max_words:
            runs = docs.mapInArrow(_counted(sizes, min(sizes[0] - 1, 2), shared), "size int, fp long, check long, n long, key long, place long")
            runs = runs.groupBy("size", "fp", "check").agg(F.sum("n").alias("n"), F.min_by("place", "key").alias("place"), F.min("key").alias("key"))
            levels.append(settle(runs.filter((F.col("size") == 0) | (F.col("n") >= min_count))))
            shared = bit_map(levels[-1], sizes[-1])
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    pointers = settle(found.groupBy("key").agg(F.collect_list(F.struct("size", "place", "fp", "check", "n")).alias("pointers")))
    texts = rows_of_ids(docs, pointers.select("key"), "key").groupBy("key").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    return texts.join(pointers, "key").select("lang", "text", "pointers").mapInArrow(_verified, "lang string, phrase string, size int, n long")


def collocations(
        docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, inside_percent: int = INSIDE_PERCENT,
        per_lang: int = PER_LANG) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases that no longer one mostly stands for.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` the words of the language;
    score = floor(2000000 * a / (l + r)).
    """
    phrases = settle(frequent_phrases(docs, min_count, max_words))
    words = F.split("phrase", " ")
    candidates = phrases.filter("size > 1").withColumnRenamed("n", "a")
    cut = candidates.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).select(
        "lang", "phrase", "a", F.struct(F.expr("2000000 * cast(a AS decimal(20)) DIV (l + r)").alias("score"), "k", "l", "r").alias("cut"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("cut").alias("cut"))
    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    around = candidates.filter("size > 2").withColumn("words", words).select("lang", "a", F.explode(inner).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = lambda name: F.col(name).cast("decimal(20)")
    own = weakest.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * whole("longer") < inside_percent * whole("a")))
    ranked = own.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").selectExpr(
        "*", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank").filter(F.col("rank") <= per_lang)
    totals = phrases.filter("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
