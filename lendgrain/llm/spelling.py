"""Spelling variants of a vocabulary, by reduced-alphabet generation.

Every letter is hashed to one of a few symbols, so a word becomes a shorter-alphabet reduced word,
and words one edit apart have reduced words at most one edit apart. The one-edit neighbourhood of
each reduced word is generated in full and joined with the reduced vocabulary; what meets is
verified on the original strings. A pair of reduced words is generated from one side only: the
longer one deletes (which covers the other's insertions), of two of one length the one with the
smaller symbol replaces it by every larger one. A pair of words therefore meets once.

Expected meetings per word are about ``neighbourhood * words / symbols ** length``. ``symbols`` is
therefore the smallest power of two, from 8 on, whose power of the shortest length is at least the
number of words. It changes the work, never the rows.

Forms: a word's form is its near word of largest count (ties: smallest in code-point order), if that
count is at least ``ratio`` times the word's. Counts grow by ``ratio`` along a chain of forms, which
bounds its length by the logarithm of the largest count; roots come from doubling the steps.

Null and empty texts have no words. A null doc_id counts like any other, without a slip. Repeated
rows count again. Very long texts and words only make more rows. An empty table gives no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendgrain.session import settle

# What a word is made of.
LETTERS = r"[A-Za-zÀ-ÿ]"
LOWER_CASE = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))

MIN_CHARS, MIN_COUNT, SLIP, RATIO, LEAST_SYMBOLS = 7, 2, 31, 10, 8


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n): runs of letters of at least ``min_chars``, A-Z as a-z, with their occurrences.

    With ``slip``, runs lose one letter before they count where the hash of doc_id and run says so:
    misspellings of a known rate.
    """
    text = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{min_chars},}}+"), F.lit(0))
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode(text).alias("run"))
    runs = runs.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    word = F.col("run")
    if slip:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % slip == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def reduced(word: Column, symbols: int) -> Column:
    """The word over the first ``symbols`` letters; letters outside ``LOWER_CASE`` stay."""
    return F.translate(word, LOWER_CASE, "".join(chr(97 + (ord(c) * 2654435761 >> 20) % symbols) for c in LOWER_CASE))


def neighbourhood(word: Column, symbols: int) -> Column:
    """Reduced words within one edit that this one has to generate, itself first, each once."""
    alphabet = F.array(*[F.lit(chr(97 + i)) for i in range(symbols)])
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))

    def with_(i: Column, symbol: Column) -> Column:
        return F.concat(F.substring(word, F.lit(1), i - 1), symbol, F.substring(word, i + 1, F.length(word)))

    def larger(i: Column) -> Column:
        return F.transform(F.filter(alphabet, lambda s: s > F.substring(word, i, F.lit(1))), lambda s: with_(i, s))

    deleted = F.transform(places, lambda i: with_(i, F.lit("")))
    return F.array_distinct(F.concat(F.array(word), deleted, F.flatten(F.transform(places, larger))))


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, near, near_n): words that differ by one inserted, deleted or replaced code point, each pair once.

    ``words``: (word, n), each word once. Letters that ``reduced`` does not know are compared too, as long as
    the two words share them.
    """
    small = reduced(F.col("word"), symbols)
    made = words.select("word", "n", F.explode(neighbourhood(small, symbols)).alias("variant"))
    made = made.select("word", "n", F.xxhash64("variant").alias("key"))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.xxhash64(small).alias("key"))
    # Equal reduced words meet from both sides; one is enough.
    once = (reduced(F.col("word"), symbols) != reduced(F.col("near"), symbols)) | (F.col("word") < F.col("near"))
    apart = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    return made.join(known, (made.key == known.key) & apart & once).select("word", "n", "near", "near_n")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form), for chains of up to ``steps`` forms."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = settle(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return reached


def variants(words: DataFrame, ratio: int = RATIO, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of (word, n)."""
    words = settle(words)
    row = words.agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).first()
    symbols = LEAST_SYMBOLS
    while symbols ** min_chars < row.words and symbols < 64:
        symbols *= 2
    near = near_pairs(words, symbols)
    sides = F.array(*[F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(c).alias("near_n"))
                      for a, b, c in (("word", "near", "near_n"), ("near", "word", "n"))])
    best = near.select(F.inline(sides)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    known = settle(known.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    longest = 1 + int(math.log(max(row.n or 1, 1), ratio)) if ratio > 1 else 1
    found = roots(known.filter("form IS NOT NULL"), longest)
    return known.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
