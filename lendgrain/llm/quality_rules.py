"""Rule-based quality verdicts: a threshold table compiled into one projection.

Every metric is a column expression over the whole text, so verdicts need no Python, no
shuffle and no second look at the text. A null text is empty: no words, no lines, failed.
Repeated rows are judged alike; other columns of ``docs`` are not read.

Words are runs outside ``\\x20 \\x09-\\x0D``. Three-word windows are compared by 64-bit
hashes: a text whose windows are all distinct is done with one hash set, others sort theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "on", "with", "as", "was", "be", "by",
    "der", "die", "das", "und", "ist", "zu", "den", "von", "mit", "nicht", "ein", "im", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "pour", "dans", "qui",
    "el", "los", "las", "del", "y", "en", "se", "por", "con", "para", "no", "su",
]


@dataclass(frozen=True)
class Rule:
    """A metric per something else must lie within bounds; an open bound is None."""

    metric: str
    per: str
    least: float | None = None
    most: float | None = None

    def column(self, metrics: Column) -> Column:
        ratio = metrics[self.metric].cast("double") / F.nullif(metrics[self.per], F.lit(0))
        bounds = []
        if self.least is not None:
            bounds.append(ratio >= self.least)
        if self.most is not None:
            bounds.append(ratio <= self.most)
        return reduce(lambda a, b: a & b, bounds)


#: Texts without lines or words fail before these are asked.
RULES = (
    Rule("word_chars", "n_words", least=1.5, most=25.0),
    Rule("n_symbols", "n_words", most=0.4),
    Rule("n_bangs", "n_words", most=0.5),
    Rule("n_stop_words", "n_words", least=0.02),
    Rule("n_dup_lines", "n_lines", most=0.6),
    Rule("n_repeat_words", "n_words", most=0.4),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    windows = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(by_hash: Column) -> Column:
        def twin(j: Column) -> Column:
            h = by_hash[j]["h"]
            same = lambda k: F.coalesce(F.get(by_hash, k)["h"] == h, F.lit(False))
            return F.when(same(j - 1) | same(j + 1), by_hash[j]["i"])
        starts = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(by_hash) - 1), twin))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def count(t: Column) -> Column:
        by_hash = F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(by_hash, covered))
    return let(windows, count)


def metrics(text: Column) -> Column:
    """Struct of counts (long) over a whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counted(name: str, column: Column) -> Column:
        return column.cast("long").alias(name)

    def of(w: Column, kept_lines: Column) -> Column:
        return F.struct(
            counted("n_words", F.size(w)), counted("word_chars", F.length(F.array_join(w, ""))),
            counted("n_symbols", F.regexp_count(text, F.lit(SYMBOLS))),
            counted("n_bangs", F.regexp_count(text, F.lit("!"))),
            counted("n_lines", F.size(kept_lines)),
            counted("n_dup_lines", F.size(kept_lines) - F.size(F.array_distinct(kept_lines))),
            counted("n_repeat_words", repeated_words(w)),
            counted("n_stop_words", F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))))
    return let(split_words(text), lambda w: let(lines, lambda kept: of(w, kept)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def passes(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The compiled table: false where the base or any rule fails."""
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), [r.column(m) for r in rules], ~base_failed(m))


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, the metrics, base_failed and kept."""
    m = F.col("m")
    return docs.select("doc_id", metrics(F.col("text")).alias("m")).select(
        "doc_id", "m.*", base_failed(m).alias("base_failed"), passes(m, rules).alias("kept"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that pass, with all their columns."""
    return docs.filter(let(metrics(F.col("text")), lambda m: passes(m, rules)))
