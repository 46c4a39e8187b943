"""Column functions over report text: keywords, labelled entities, lists, numbers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that void a keyword when they stand shortly before it.
NEGATORS = ["no", "not", "without", "nil", "none", "absence of"]
NEGATION_GAP = r"[^.;,\n]{0,25}"
# Verbs that show a captured "entity" is really a sentence.
SENTENCE_VERBS = r"(?iu)\b(concentration|accounts? for|contributed|reported|remained|increased)\b"
# Characters cut from both ends of a captured item, and list separators.
ITEM_EDGE = " .,:;\n\t"
LIST_SEPARATOR = r",| and |/|;"
# Phrasings of a rise in collection days.
DAYS_RISE = [
    r"(?iu)receivable(?:s)?\s+days\s+(?:increased|rose)\s+from\s+(\d+)\s+to\s+(\d+)",
    r"(?iu)collection\s+period\s+(?:increased|rose)\s+from\s+(\d+)\s+to\s+(\d+)",
]


def quote(word: str) -> str:
    """A word as a Java regular expression that matches it literally."""
    return re.sub(r"([^\w\s])", r"\\\1", word)


def alternation(words: list[str]) -> str:
    return "(?:" + "|".join(quote(w) for w in words) + ")"


def for_lowered(pattern: str) -> str:
    """The pattern without its case flags and with its capitals lowered, for lowered text.

    Matching lowered text literally is several times faster in Java than matching any
    text under the Unicode case flags. Escapes such as ``\\S`` keep their case.
    """
    bare = re.sub(r"^\(\?iu\)", "", pattern)
    return re.sub(r"(\\.)|([A-Z]+)", lambda m: m.group(1) or m.group(2).lower(), bare)


def same_length_lower(col: Column) -> Column:
    """Lower case with unchanged offsets: where lowering would lengthen the text, ASCII only."""
    low = F.lower(col)
    return F.when(F.length(low) == F.length(col), low).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def letter_first(pattern: str) -> str:
    """A pattern that opens on a word boundary and a letter, looking for the letter first; it matches the same.

    The boundary of Unicode words costs far more than one character, and was tried at every place.
    """
    return re.sub(r"^\\b(?=([a-z])(?![?*{]))", r"(?=\1)\\b", pattern)


def collapse_space(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\s+", " ")


def contains_any(col: Column, words: list[str], whole_word: bool = False, lowered: bool = False) -> Column:
    """True if a keyword occurs that no negator governs.

    The look-behind sits after the keyword look-ahead, so it only runs where a
    keyword starts. By default negators match inside words too ("notes" voids);
    ``whole_word`` asks for word boundaries around them. ``lowered`` promises that the
    text and the words are in lower case.
    """
    negator = "|".join(NEGATORS)
    negator = rf"\b(?:{negator})\b" if whole_word else rf"(?:{negator})"
    flags = "" if lowered else "(?iu)"
    free = col.rlike(rf"{flags}(?={alternation(words)})(?<!{negator}{NEGATION_GAP})")
    if not lowered:
        return free
    # A plain search spares texts without a keyword the pattern; words that hold another one add nothing to it.
    shortest = [w for w in words if not any(v != w and v in w for v in words)]
    return F.when(~reduce(Column.__or__, [col.contains(w) for w in shortest]), False).otherwise(free)


def percent_near(col: Column, phrase: str, lowered: bool = False) -> Column:
    """First percentage within 80 characters after a phrase."""
    flags = "" if lowered else "(?iu)"
    share = F.regexp_extract(col, rf"{flags}{quote(phrase)}[^%\n]{{0,80}}?(\d{{1,3}})\s*%", 1).try_cast("int")
    return F.when(col.contains(phrase), share) if lowered else share


def days_jump(col: Column, least: int = 10, lowered: bool = False) -> Column:
    """True if collection days are said to have risen by at least ``least``."""
    patterns = [for_lowered(p) for p in DAYS_RISE] if lowered else DAYS_RISE
    rises = [
        F.regexp_extract(col, p, 2).try_cast("bigint") - F.regexp_extract(col, p, 1).try_cast("bigint") >= least
        for p in patterns
    ]
    if lowered:
        rises = [F.when(col.contains(word), rise) for word, rise in zip(("receivable", "collection"), rises)]
    return F.coalesce(rises[0], F.lit(False)) | F.coalesce(rises[1], F.lit(False))


def clean_item(col: Column) -> Column:
    return F.btrim(collapse_space(col), F.lit(ITEM_EDGE))


def label_entity(col: Column, labels: list[str], lowered: Column | None = None) -> Column:
    """Entity named after the first label whose capture does not read as a sentence.

    ``lowered`` is the same text in lower case: a substring test on it spares texts
    without the label the pattern.
    """
    found = None
    low = F.lower(col) if lowered is None else lowered
    for label in labels:
        raw = _behind(low, label, col, rf"(?iu){quote(label)}(?:s)?\s*(?:include|is|are)\s*[:\-]?\s*([^.\n]+)", 1)
        item = clean_item(raw)
        usable = (F.length(raw) > 0) & ~item.rlike(SENTENCE_VERBS)
        found = F.when(usable, F.nullif(item, F.lit(""))) if found is None else found.when(
            usable, F.nullif(item, F.lit("")))
    return found


def _behind(low: Column, label: str, col: Column, pattern: str, group: int) -> Column:
    return F.when(low.contains(label), F.regexp_extract(col, pattern, group)).otherwise("")


def first_of(items: Column, k: int | None) -> Column:
    """First k elements, or all of them without a k."""
    return items if k is None else F.slice(items, 1, k)


def first_chars(text: Column, n: int | None) -> Column:
    """First n characters, or all of them without an n."""
    return text if n is None else F.substring(text, 1, n)


def label_list(col: Column, labels: list[str], most: int | None = 6, lowered: Column | None = None) -> Column:
    """Items listed after the first label present, ``most`` of them unless that is None."""
    found = None
    low = F.lower(col) if lowered is None else lowered
    for label in labels:
        raw = _behind(low, label, col, rf"(?iu){quote(label)}\s*[:\-]\s*([^.\n]+)", 1)
        found = F.when(F.length(raw) > 0, raw) if found is None else found.when(F.length(raw) > 0, raw)
    items = F.filter(F.transform(F.split(found, LIST_SEPARATOR, -1), clean_item), lambda x: F.length(x) > 0)
    return F.coalesce(first_of(items, most), F.array().cast("array<string>"))


def word_tokens(col: Column) -> Column:
    """Maximal runs of word characters, the units a word boundary separates."""
    return F.filter(F.split(col, r"(?U)\W+", -1), lambda w: F.length(w) > 0)


def word_count(col: Column) -> Column:
    """Number of words once every character that is neither word nor space became a space."""
    return F.size(word_tokens(col))


def count_words(tokens: Column, lowered: Column, terms: list[str]) -> Column:
    """Whole-word occurrences of all terms together.

    Terms made of word characters are counted by hash lookup over the tokens; only
    terms with a hyphen, blank or sign need a pattern, behind a plain substring test.
    """
    plain = [t for t in terms if re.fullmatch(r"\w+", t)]
    mixed = [t for t in terms if not re.fullmatch(r"\w+", t)]
    total = F.size(F.filter(tokens, lambda w: w.isin(*plain))) if plain else F.lit(0)
    for term in mixed:
        total = total + phrase_count(lowered, term)
    return total


def phrase_count(lowered: Column, phrase: str) -> Column:
    pattern = rf"(?U)\b{quote(phrase)}\b"
    return F.when(lowered.contains(phrase), F.regexp_count(lowered, F.lit(pattern))).otherwise(F.lit(0))
