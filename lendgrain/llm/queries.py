"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendgrain.llm import (
    checks, decontamination, exact_search, extraction, line_dedup, mixing, near_dup, phrases, pii, quality, quality_rules, spelling,
    substring_dedup, toxicity)
from lendgrain.llm.registry import CHECKS, QUERIES, query, table

__all__ = ["CHECKS", "QUERIES"]


@query("op1_benchmark_leaks")
def op1(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_mix_sources")
def op2(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op3_personal_data")
def op3(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op4_main_text")
def op4(spark, sf_dir):
    texts = extraction.main_texts(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_quality")
def op6(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_line_dedup")
def op7(spark, sf_dir):
    lines = line_dedup.deduplicated(table(spark, sf_dir, "documents"), short=True)
    return lines.select(
        "doc_id", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@query("op8_repeated_substrings")
def op8(spark, sf_dir):
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUALITY_RULES_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM texts),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, shingle) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS near(k) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!'))::BIGINT AS n_bangs,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len([x FOR x IN w IF list_contains(STOPS, lower(x))]) AS n_stop_words
  FROM split LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.4
  AND n_bangs / n_words <= 0.5 AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.6
  AND n_repeat_words / n_words <= 0.4 AS kept
FROM judged
""".replace("STOPS", "[" + ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS) + "]")


@query("op9_quality_rules", QUALITY_RULES_SQL)
def op9(spark, sf_dir):
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_near_duplicates")
def op10(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op11_spelling_variants", checks.SPELLING)
def op11(spark, sf_dir):
    words = spelling.vocabulary(table(spark, sf_dir, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_exact_search", checks.EXACT_SEARCH)
def op12(spark, sf_dir):
    return exact_search.top_matches(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op13_phrases", checks.PHRASES)
def op13(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
