"""Document structure: pages, clean-up, headings, sections and entity names."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendgrain import fixed_values as fv
from lendgrain.functions import text as tx
from lendgrain.functions.parsing import strip
from lendgrain.functions.spans import let
from lendgrain.operators.filings import TEXT, keys_of

PAGE_STRETCH, STRETCH_ROWS = 16, 500_000
SUFFIX_EDGE = ",.- "
LINE_BREAK = r"\r\n|[\n\r\x{0b}\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


# --- Pages ---------------------------------------------------------------------------
def assemble_pages(pages: DataFrame, least_chars: int = 50, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Document text with page markers, and the share of pages that carry content."""
    marked = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce(TEXT, F.lit("")))
    content = F.count_if(F.length(TEXT) > least_chars)
    return pages.groupBy(*by).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("page_number", marked.alias("t")))), lambda p: p["t"]), "\n\n").alias(TEXT),
        F.count(F.lit(1)).alias("pages_extracted"), content.alias("pages_with_content"),
        F.sum(F.length(F.coalesce(TEXT, F.lit("")))).alias("total_characters"),
        (content / F.count(F.lit(1)) * 100).alias("extraction_coverage"))


def classify_docs(documents: DataFrame, pages: DataFrame, sample: int = 10, least_mean: float = 100.0) -> DataFrame:
    """Text or scanned, from the mean length of the first pages; no pages means scanned."""
    means = pages.filter(F.col("page_number") <= sample).groupBy("doc_id").agg(
        F.avg(F.length(F.coalesce(TEXT, F.lit("")))).alias("mean_chars"))
    return documents.select("doc_id").distinct().join(means, "doc_id", "left").select(
        "doc_id", "mean_chars",
        F.when(F.col("mean_chars") > least_mean, "text").otherwise("scanned").alias("kind"))


# --- Clean-up ------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def merge_lines(col: Column) -> Column:
    """Join a short unfinished line with a following line that starts in lower case.

    Whether a line wants its successor depends on the two lines only. A merge uses up
    the successor, so of a run of wanting lines every second one merges: read from
    left to right, each wanting flag takes the flag after it along.
    """
    def wants(lines: Column, i: Column) -> Column:
        line, follower = F.get(lines, i), F.get(lines, i + 1)
        return (
            (F.length(line) > 0) & (F.length(line) < 80) & ~line.rlike(r"[.!?:;]$")
            & F.coalesce(follower.rlike(r"^\p{Ll}"), F.lit(False)))

    def marks(lines: Column) -> Column:
        flags = F.array_join(F.transform(
            F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.when(wants(lines, i), "1").otherwise("0")), "")
        return F.regexp_replace(flags, "1.", "MS")

    def joined(lines: Column, plan: Column) -> Column:
        kept = F.transform(lines, lambda line, i: F.when(
            F.substring(plan, i + 1, F.lit(1)) == "M", F.concat(line, F.lit(" "), F.get(lines, i + 1))
        ).when(F.substring(plan, i + 1, F.lit(1)) != "S", line))
        return F.array_join(F.array_compact(kept), "\n")

    stripped = F.transform(F.split(col, "\n", -1), strip)
    return let(stripped, lambda lines: let(marks(lines), lambda plan: joined(lines, plan)))


def clean_text(documents: DataFrame) -> DataFrame:
    """Drop noise, normalise characters, rejoin split words and lines, collapse blank lines.

    Only texts with characters outside ASCII travel to Python, in Arrow batches.
    """
    col = F.replace(F.col(TEXT), F.lit("\f"), F.lit("\n"))
    for noise in (r"[\x{200b}-\x{200f}\x{feff}]", "-{5,}", "_{5,}"):
        col = F.regexp_replace(col, noise, "")
    quiet = documents.withColumn("_quiet", col)
    exotic = F.when(F.col("_quiet").rlike(r"[^\x00-\x7f]"), F.col("_quiet"))
    plain = quiet.withColumn("_plain", F.coalesce(nfkc(exotic), F.col("_quiet")))
    col = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), fv.PLAIN_CHARACTERS, F.col("_plain"))
    col = F.regexp_replace(col, r"([A-Za-z]{2,})-\s*\n\s*([A-Za-z]{2,})", "$1$2")
    whole = plain.withColumn("_whole", col)
    merged = F.regexp_replace(merge_lines(F.col("_whole")), r"\n{3,}", "\n\n")
    return whole.select(*keys_of(documents), F.when(F.length(TEXT) > 0, merged).otherwise("").alias(TEXT))


# --- Headings ------------------------------------------------------------------------
def heading_confidence(line: Column, following: Column) -> Column:
    """Score of a line as a heading; null for lines that cannot be one."""
    tokens = lambda c: F.filter(F.split(c, r"(?U)\s+", -1), lambda w: F.length(w) > 0)
    add = lambda cond, amount: F.when(cond, F.lit(amount)).otherwise(F.lit(0.0))
    facts = F.struct(strip(line).alias("line"), tokens(line).alias("words"))

    def score(f: Column) -> Column:
        text, words = f["line"], f["words"]
        n, capitals = F.size(words), F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        dense = F.when(n <= 8, F.size(tokens(F.coalesce(following, F.lit("")))) > 15).otherwise(False)
        total = (
            add(is_upper(text) & (n >= 2), 0.4) + add((n >= 2) & (capitals >= n * F.lit(0.7)), 0.3)
            + add(F.lower(text).rlike(tx.alternation(fv.HEADING_KEYWORDS)), 0.25) + add(dense, 0.2)
            + add(text.rlike(r"^(\d+\.?\d*|[A-Z]\.)\s+\w"), 0.3) - add(n > 12, 0.2))
        possible = (F.length(text) >= 3) & ~text.rlike(r"^\d+$") & ~text.rlike(r"(?i)^page\s+\d+")
        return F.when(possible, total)

    return let(facts, score)


def with_neighbours(documents: DataFrame) -> DataFrame:
    """Lines of each document with the line before and after; the text is cut in its row."""
    lines = F.transform(F.split(TEXT, LINE_BREAK, -1), lambda l: F.regexp_replace(l, r"\s+$", ""))
    around = let(lines, lambda ls: F.transform(ls, lambda l, i: F.struct(
        i.alias("line_no"), l.alias("line"), F.when(i > 0, F.get(ls, i - 1)).alias("before"), F.get(ls, i + 1).alias("after"))))
    return documents.select(*keys_of(documents), F.inline(around))


def is_upper(line: Column) -> Column:
    return (F.upper(line) == line) & (F.lower(line) != line)


def _sections(lines: Column, least: float) -> Column:
    scored = F.transform(lines, lambda l, i: heading_confidence(l, F.get(lines, i + 1)))
    body = lambda first, count: F.filter(F.transform(F.slice(lines, first, count), strip), lambda l: F.length(l) > 0)

    def build(scores: Column, heads: Column) -> Column:
        ends = lambda j: F.coalesce(F.get(heads, j + 1), F.size(lines))
        return F.transform(heads, lambda h, j: F.struct(
            (j + 1).alias("section_no"), strip(F.get(lines, h)).alias("heading"),
            F.when(is_upper(strip(F.get(lines, h))) & F.get(lines, h).rlike(r"\S\s+\S"), 1).otherwise(2).alias("level"),
            F.get(scores, h).alias("confidence"), body(h + 2, ends(j) - h - 1).alias("content")))

    whole = F.array(F.struct(
        F.lit(1).alias("section_no"), F.lit("(MD&A Text)").alias("heading"), F.lit(1).alias("level"),
        F.lit(None).cast("double").alias("confidence"),
        F.filter(lines, lambda l: F.length(strip(l)) > 0).alias("content")))
    at = lambda scores: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(scores, i) >= least)
    return let(scored, lambda scores: let(at(scores), lambda heads: F.when(
        F.size(heads) > 0, build(scores, heads)).otherwise(whole)))


def section_tree(documents: DataFrame, least: float = 0.35) -> DataFrame:
    """Headings found by layout cues, each with the non-blank lines up to the next one."""
    lines = F.transform(F.split(TEXT, LINE_BREAK, -1), lambda l: F.regexp_replace(l, r"\s+$", ""))
    return documents.select(
        *keys_of(documents), F.inline(let(lines, lambda ls: _sections(ls, least)))
    )


# --- Sections over layout blocks -----------------------------------------------------
def page_fonts(blocks: DataFrame) -> DataFrame:
    """Upper median font size per page, from counts per size."""
    page = Window.partitionBy("doc_id", "page")
    sizes = blocks.groupBy("doc_id", "page", "font").agg(F.count(F.lit(1)).alias("n"))
    return (
        sizes.withColumn("reached", F.sum("n").over(page.orderBy("font")))
        .withColumn("rank", F.floor(F.sum("n").over(page) / 2) + 1)
        .filter("reached >= rank AND reached - n < rank")
        .select("doc_id", "page", F.col("font").alias("median_font"))
    )


def find_sections(blocks: DataFrame, sections: list[tuple] | None = None) -> DataFrame:
    """Start, end and confidence of each section from headings in the page layout.

    ``blocks``: doc_id, block_no, page, font, y, text. The best heading wins, the
    earlier block on ties; a section ends before the next page with an end heading.
    """
    sections = sections or fv.SECTIONS
    normal = F.lower(strip(tx.collapse_space(F.col(TEXT))))
    sized = blocks.join(page_fonts(blocks), ["doc_id", "page"]).withColumns(
        {"norm": normal, "size": F.length(strip(F.col(TEXT)))})
    heads = sized.withColumn("is_head", (F.col("size") <= 150) & (F.col("font") >= F.col("median_font") * 0.95))

    def confidence(keyword: str) -> Column:
        fit = F.when(F.col("norm") == keyword, 0.3).when(
            F.col("norm").startswith(keyword) | F.col("norm").endswith(keyword), 0.2).otherwise(0.1)
        return F.least(
            F.lit(0.5) + fit + F.when(F.col("y") < 150, 0.1).otherwise(0.0) + F.when(F.col("size") < 50, 0.05).otherwise(0.0),
            F.lit(1.0))

    parts = []
    for name, starts, ends in sections:
        score = F.coalesce(*[F.when(F.col("norm").contains(k), confidence(k)) for k in starts])
        parts.append(F.struct(
            F.lit(name).alias("section"), F.when(F.col("is_head"), score).alias("score"),
            (F.lit(name == fv.FALLBACK_SECTION) & F.col("norm").contains(fv.FALLBACK_PHRASE)).alias("mentioned"),
            (F.col("is_head") & F.col("norm").rlike(tx.alternation(ends))).alias("is_end")))
    marked = heads.select("doc_id", "block_no", "page", TEXT, F.inline(F.array(*parts))).filter(
        "score IS NOT NULL OR mentioned OR is_end")
    best = F.struct(F.col("score"), (-F.col("block_no")).alias("earlier"))
    starts = marked.groupBy("doc_id", "section").agg(
        F.max_by(F.struct("page", TEXT, "score"), F.when(F.col("score").isNotNull(), best)).alias("b"),
        F.min_by(F.struct("page", TEXT, F.lit(0.5).alias("score")), F.when(F.col("mentioned"), F.col("block_no"))).alias("m"),
    ).withColumn("s", F.coalesce("b", "m")).filter("s IS NOT NULL").select(
        "doc_id", "section", F.col("s.page").alias("start_page"), F.col(f"s.{TEXT}").alias("heading"),
        F.col("s.score").alias("confidence"))
    ends = marked.filter("is_end").select("doc_id", "section", "page").distinct()
    closing = starts.join(ends, ["doc_id", "section"]).filter("page > start_page").groupBy("doc_id", "section").agg(
        (F.min("page") - 1).alias("end_page"))
    return starts.join(closing, ["doc_id", "section"], "left").withColumn(
        "end_page", F.coalesce("end_page", F.col("start_page") + 10))


def section_summary(sections: DataFrame) -> DataFrame:
    return sections.select(
        "doc_id", "section", "start_page", "end_page", (F.col("end_page") - F.col("start_page") + 1).alias("page_count"),
        F.round("confidence", 3).alias("confidence"), F.col("heading").alias("detected_heading"))


def section_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages inside a section's range of pages, with the section's name; all other pages are left out.

    ``pages``: doc_id, page_number and text; ``sections``: doc_id, section, start_page, end_page. A
    range is cut into stretches of ``PAGE_STRETCH`` pages, so the join is one of equal keys, and a
    document of very many pages is split over tasks. Up to ``STRETCH_ROWS`` stretches go to the pages,
    which then drop the others before anything is shuffled; more meet them in a shuffle.
    """
    stretch = lambda page: F.floor(F.col(page) / F.lit(PAGE_STRETCH))
    wanted = sections.filter("start_page <= end_page").select(
        "doc_id", "section", "start_page", "end_page", F.explode(F.sequence(stretch("start_page"), stretch("end_page"))).alias("_stretch"))
    if wanted.limit(STRETCH_ROWS + 1).count() <= STRETCH_ROWS:
        wanted = F.broadcast(wanted)
    return pages.withColumn("_stretch", stretch("page_number")).join(wanted, ["doc_id", "_stretch"]).filter(
        "page_number BETWEEN start_page AND end_page").drop("_stretch", "start_page", "end_page")


def section_texts(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Text of each section's pages, with page markers and counts, per doc_id and section."""
    return assemble_pages(section_pages(pages, sections), by=("doc_id", "section"))


# --- Entity names --------------------------------------------------------------------
def strip_suffixes(name: Column) -> Column:
    """Cut company suffixes and punctuation from the end until none is left."""
    # Dots at the end are trimmed before suffixes are looked for, so those with one never fit.
    bare = sorted({s.strip() for s in fv.COMPANY_SUFFIXES if not s.endswith(".")}, key=len, reverse=True)
    words = "|".join(tx.quote(s) for s in bare)
    cut = F.regexp_replace(F.btrim(name, F.lit(SUFFIX_EDGE)), rf"(?iu)(?: (?:{words})[,.\- ]*)+$", "")
    return F.btrim(cut, F.lit(SUFFIX_EDGE))


def entity_name(filings: DataFrame, numbered: bool = False) -> DataFrame:
    """Company name from the file name, else from the lines above the report title.

    ``filings``: keys, file_name, first_page. By default a line that holds the digits of a year is a
    date; ``numbered`` lets one that ends on a company suffix be a name ("Beta Works 2001 Limited").
    """
    keys = [c for c in filings.columns if c not in ("file_name", "first_page")]
    base = F.replace("file_name", F.lit(".pdf"), F.lit(""))
    titled = F.regexp_extract(base, r"(?iu)^(.+?)[_-](?:Annual(?:_|\s)?Report|BRSR)", 1)
    left = F.regexp_replace(base, r"(?iu)(annual_?report|brsr|financial_?statements)", "")
    left = strip(F.regexp_replace(F.regexp_replace(left, r"20\d{2}[_-]?(\d{2})?", ""), r"[\d_]", " "))
    from_file = F.when(F.length(titled) > 0, strip(F.replace(titled, F.lit("_"), F.lit(" ")))).when(
        F.length(left) > 2, left)
    lines = F.filter(F.transform(F.split("first_page", "\n", -1), strip), lambda l: F.length(l) > 0)
    undated = lambda l: F.when(strip_suffixes(l) != F.btrim(l, F.lit(SUFFIX_EDGE)), F.regexp_replace(l, r"20\d{2}", "")).otherwise(l)
    named = lambda l: (F.length(l) > 4) & ~l.rlike(r"^\d+$") & ~(undated(l) if numbered else l).rlike(fv.NOT_A_COMPANY)
    above = lambda ls, i, back: F.when((i >= back) & named(F.get(ls, i - back)), F.get(ls, i - back))
    from_page = let(lines, lambda ls: F.get(F.array_compact(F.transform(
        ls, lambda l, i: F.when(F.lower(l).contains("annual report"), F.coalesce(above(ls, i, 1), above(ls, i, 2))))),
        F.lit(0)))
    prepared = filings.withColumns({"_base": base, "_file": from_file, "_page": from_page})
    chosen = F.when(F.length("_file") > 4, F.col("_file")).otherwise(
        F.coalesce("_page", F.nullif("_file", F.lit("")), "_base"))
    safe = strip(tx.collapse_space(F.regexp_replace(chosen, r'[\\/*?:"<>|()\[\]]', "")))
    aliases = F.create_map(*[F.lit(v) for pair in fv.TICKER_NAMES for v in pair])
    cut = prepared.withColumn("_name", strip_suffixes(safe))
    return cut.select(*keys, F.coalesce(
        F.try_element_at(aliases, F.upper("_name")), F.col("_name")).alias("entity_name"), F.lower("first_page").alias("_p"),
    ).drop("_p")


def title_candidate(first_page: Column, read: int | None = 3000) -> Column:
    """Capitalised line right above the report title, unless it is a date or generic.

    ``read``: how many characters of the page are looked at; None for all.
    """
    found = strip(F.regexp_extract(
        tx.first_chars(first_page, read),
        r"([A-Z][A-Za-z\s&\-.]{4,60})\s*\n[^\n]*(?:Annual\s+Report|ANNUAL\s+REPORT)", 1))
    return F.when((F.length(found) > 0) & ~found.rlike(fv.NOT_A_COMPANY), found)


def resolve_name(named: DataFrame) -> DataFrame:
    """Replace a generic name by the registry name, or without one by the title candidate.

    ``named``: entity_name, registry_name, fallback_name and keys.
    """
    low = F.lower("entity_name")
    generic = low.contains("annual") | low.contains("report") | (F.length("entity_name") < 4)
    return named.withColumn("resolved_name", F.when(
        generic & F.col("registry_name").isNotNull(), F.initcap("registry_name")
    ).when(generic & F.col("fallback_name").isNotNull(), F.col("fallback_name")).otherwise(F.col("entity_name")))
