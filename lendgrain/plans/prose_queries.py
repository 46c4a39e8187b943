"""Prose and layout queries: tone, keywords, site notes, media, pages, headings, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendgrain import fixed_values as fv
from lendgrain.functions import text as tx
from lendgrain.operators import layout, prose
from lendgrain.plans.bindings import DOCS, NOTES, View
from lendgrain.plans.registry import query
from lendgrain.session import settle, spread
from lendgrain.sources import reports

# Lexicons of words that occur in the supplied prose.
TONE = {
    "negative": ["no", "worthless", "stupid", "er", "re", "by-nc"],
    "positive": ["and", "the", "und", "la", "of the"],
    "uncertain": ["is", "that", "it is", "was", "en"],
}
SIDES = {
    "exploration": ["the", "of", "and", "of the", "in", "der", "that", "is", "it", "for", "was", "on"],
    "exploitation": ["worthless", "stupid", "license", "la", "and the", "by", "this", "with", "que", "et"],
}
MARKERS = ["worthless", "stupid", "license", "that the"]
MEDIA = [("worthless", 2.0), ("stupid", 1.5), ("that the", 1.0), ("license", 2.5), ("and the", 0.5)]
MITIGANTS = [" no ", "with the"]
WORDS = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def quoted(words):
    return ", ".join(f"'{w}'" for w in words)


def phrase_sql(phrase: str) -> str:
    """Whole-word count of a phrase: separators are doubled so that neighbours share none."""
    wide = "regexp_replace(low, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')"
    inner = "".join(c if c.isalnum() else c * 2 for c in phrase)
    return f"len(regexp_extract_all({wide}, '(?:^|[^\\p{{L}}\\p{{N}}_]){inner}(?:$|[^\\p{{L}}\\p{{N}}_])'))"


def count_sql(words: list[str]) -> str:
    plain, mixed = [w for w in words if w.isalnum()], [w for w in words if not w.isalnum()]
    return " + ".join([f"len(list_filter(ws, lambda w: w IN ({quoted(plain)})))"] + [phrase_sql(p) for p in mixed])


LOW = f"""WITH {DOCS.cte}, l AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low FROM docs),
w AS (SELECT *, {WORDS.format("low")} AS ws FROM l)"""


def docs(spark, sf_dir):
    return DOCS.frame(spark, sf_dir).select("doc_id", "text")


@query("lexicon_sentiment", f"""{LOW}, c AS (SELECT doc_id, length(trim(text)) >= 100 AS ok, len(ws) AS n,
  {count_sql(TONE["negative"])} AS neg, {count_sql(TONE["positive"])} AS pos, {count_sql(TONE["uncertain"])} AS unc FROM w)
SELECT doc_id, CASE WHEN NOT ok THEN 'insufficient_text' WHEN n = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN ok THEN round((pos - neg) / CAST(n AS DOUBLE), 4) ELSE 0.0 END AS sentiment_score,
  CASE WHEN ok THEN round((neg + unc) / CAST(n AS DOUBLE), 4) ELSE 0.0 END AS risk_intensity,
  CAST(n AS INTEGER) AS total_words, CAST(neg AS INTEGER) AS negative_words, CAST(pos AS INTEGER) AS positive_words,
  CAST(unc AS INTEGER) AS uncertain_words,
  CASE WHEN ok AND round((pos - neg) / CAST(n AS DOUBLE), 4) < -0.01 THEN 'P-16' ELSE '' END AS triggered_rules FROM c""")
def lexicon_sentiment(spark, sf_dir):
    return prose.lexicon_sentiment(docs(spark, sf_dir), TONE).withColumn(
        "triggered_rules", F.array_join("triggered_rules", ","))


@query("headwinds", f"""WITH {DOCS.cte}, s AS (SELECT doc_id, list_filter(string_split(
  regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: length(x) > 40 AND regexp_matches(lower(x), '{"|".join(MARKERS)}')) AS ss FROM docs),
u AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS rank, unnest(ss) AS sentence FROM s)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, trim(regexp_replace(sentence, '\\s+', ' ', 'g')) AS sentence FROM u
WHERE rank <= 6""")
def headwinds(spark, sf_dir):
    return prose.headwinds(docs(spark, sf_dir), MARKERS)


def top_sql(words: list[str]) -> str:
    pairs = ", ".join(
        f"{{'n': -({count_sql([w]) if w.isalnum() else phrase_sql(w)}), 'p': {i}, 'k': '{w}'}}" for i, w in enumerate(words))
    return (f"array_to_string(list_transform(list_slice(list_sort(list_filter([{pairs}], lambda x: x.n < 0)), 1, 10), "
            "lambda x: x.k || '=' || -x.n), ',')")


@query("ambidexterity", f"""{LOW}, c AS (SELECT doc_id, len(ws) AS n, {count_sql(SIDES["exploration"])} AS up,
  {count_sql(SIDES["exploitation"])} AS down, {top_sql(SIDES["exploration"])} AS tu, {top_sql(SIDES["exploitation"])} AS td FROM w)
SELECT doc_id, CAST(n AS INTEGER) AS total_words, CAST(up AS INTEGER) AS exploration_frequency,
  CAST(down AS INTEGER) AS exploitation_frequency, tu AS top_exploration_keywords, td AS top_exploitation_keywords,
  round(up / CAST(n AS DOUBLE), 6) AS exploration_score, round(down / CAST(n AS DOUBLE), 6) AS exploitation_score,
  round((up + down) / CAST(n AS DOUBLE), 6) AS ambidexterity_score,
  CASE WHEN down > 0 THEN round(up / CAST(down AS DOUBLE), 4) END AS ratio,
  CASE WHEN down > 0 THEN CAST(round(up / CAST(down AS DOUBLE), 4) AS VARCHAR) WHEN up > 0 THEN '∞ (exploitation=0)'
    ELSE 'N/A' END AS ratio_text FROM c""")
def ambidexterity(spark, sf_dir):
    shown = lambda c: F.array_join(F.transform(
        c, lambda k: F.concat(k["keyword"], F.lit("="), k["hits"].cast("string"))), ",")
    return prose.ambidexterity(docs(spark, sf_dir), SIDES).withColumns({
        c: shown(c) for c in ("top_exploration_keywords", "top_exploitation_keywords")})


# --- Site notes ----------------------------------------------------------------------
RULE = {r[0]: r for r in fv.RULES}


def site_sql() -> str:
    parts = []
    for rule_id, meaning, patterns in fv.SITE_SIGNALS:
        _, name, bps, cut, _, severity, _ = RULE[rule_id]
        plain = [p.replace("(?!\\s+account)", "").replace("'", "''") for p in patterns]
        if rule_id == fv.CAPACITY_RULE:
            cap = "coalesce(" + ", ".join(f"nullif(regexp_extract(low, '{p}', 1), '')" for p in plain) + ")"
            cond, desc = f"CAST({cap} AS DOUBLE) < 60", (
                f"CASE WHEN CAST({cap} AS DOUBLE) > 0 THEN 'Factory operating at ' || CAST({cap} AS INTEGER) || "
                f"'% capacity — below 60% threshold' ELSE '{meaning}' END")
        else:
            cond, desc = "(" + " OR ".join(f"regexp_matches(low, '{p}')" for p in plain) + ")", f"'{meaning}'"
        first = "coalesce(" + ", ".join(f"nullif(regexp_extract(low, '{p}', 0), '')" for p in plain) + ")"
        at = f"(strpos(lower(notes), {first}) - 1)"
        around = f"trim(substr(notes, greatest({at} - 20, 0) + 1, {at} + length({first}) + 20 - greatest({at} - 20, 0)))"
        parts.append(f"SELECT note_id, applicant_id, '{rule_id}' AS rule_id, '{name}' AS rule_name, {desc} AS description, {around} AS matched_text, "
                     f"'{severity}' AS severity, {bps} AS rate_penalty_bps, {cut} AS limit_reduction_pct FROM n WHERE {cond}")
    return " UNION ALL ".join(parts)


SITE = f"""WITH {NOTES.cte}, n AS (SELECT *, regexp_replace(lower(notes), '\\bclosed\\s+account', 'x', 'g') AS low FROM notes),
found AS ({site_sql()})"""


@query("site_visit_signals", f"{SITE} SELECT * FROM found")
def site_visit_signals(spark, sf_dir):
    return prose.site_visit_signals(NOTES.frame(spark, sf_dir))


@query("site_visit_totals", f"""{SITE}, t AS (SELECT applicant_id, count(*) AS findings,
  count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
  CAST(sum(rate_penalty_bps) AS BIGINT) AS total_penalty_bps,
  CAST(sum(limit_reduction_pct) AS BIGINT) AS total_limit_reduction_pct,
  string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS triggered_rules FROM found GROUP BY 1)
SELECT *, findings || ' site visit risk(s) detected — ' || high || ' HIGH, ' || medium || ' MEDIUM. Total additional penalty: +'
  || total_penalty_bps || 'bps, limit reduction: -' || total_limit_reduction_pct || '%' AS risk_summary FROM t""")
def site_visit_totals(spark, sf_dir):
    found = prose.site_visit_signals(NOTES.frame(spark, sf_dir))
    return prose.site_visit_totals(found, ["applicant_id"]).withColumn(
        "triggered_rules", F.array_join("triggered_rules", ","))


PHRASES = " UNION ALL ".join(
    f"SELECT note_id, applicant_id, capacity_pct, '{d}' AS signal, 'HIGH' AS severity FROM n WHERE lower(notes) LIKE '%{p}%'"
    for p, d in fv.SITE_RED_FLAGS)


@query("site_visit_scan", f"""WITH {NOTES.cte}, n AS (SELECT *,
  TRY_CAST(regexp_extract(notes, '(\\d+)\\s*%\\s*capac', 1, 'i') AS INTEGER) AS capacity_pct FROM notes),
f AS (SELECT note_id, applicant_id, capacity_pct, 'Plant operating at ' || capacity_pct || '% capacity' AS signal,
  CASE WHEN capacity_pct < 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM n WHERE capacity_pct < 60
  UNION ALL {PHRASES})
SELECT *, 'P-07' AS rule_id FROM f""")
def site_visit_scan(spark, sf_dir):
    return prose.site_visit_scan(NOTES.frame(spark, sf_dir))


# --- Adverse media -------------------------------------------------------------------
BLOCKS = View("blocks", "documents", (
    "source AS applicant_id", "doc_id AS page_id", "CAST(0 AS INTEGER) AS block_no", "lower(text) AS text"))
KEYWORDS = ", ".join(f"('{k}', CAST({w} AS DOUBLE), {n})" for n, (k, w) in enumerate(MEDIA))
HITS = f"""WITH {BLOCKS.cte}, sp AS (SELECT applicant_id, page_id, block_no, regexp_split_to_array(text, '[.!?;]\\s+') AS ss
  FROM blocks), st AS (SELECT applicant_id, page_id, block_no, unnest(range(0, len(ss))) AS sentence_no,
  trim(unnest(ss), ' ' || chr(10)) AS sentence FROM sp), kw(keyword, weight, ord) AS (VALUES {KEYWORDS}),
x AS (SELECT * FROM st JOIN kw ON contains(sentence, keyword) WHERE length(sentence) >= 20
  AND NOT (contains(sentence, ' no ') OR contains(sentence, 'with the'))),
r AS (SELECT *, row_number() OVER (PARTITION BY applicant_id, keyword, left(sentence, 60)
  ORDER BY page_id, block_no, sentence_no) AS rn FROM x),
hits AS (SELECT applicant_id, page_id, block_no, CAST(sentence_no AS INTEGER) AS sentence_no, ord, keyword, weight,
  left(sentence, 200) AS sentence FROM r WHERE rn = 1)"""


def media_hits(spark, sf_dir):
    return prose.adverse_hits(BLOCKS.frame(spark, sf_dir), MEDIA, MITIGANTS)


@query("adverse_hits", f"{HITS} SELECT * FROM hits")
def adverse_hits(spark, sf_dir):
    return media_hits(spark, sf_dir)


@query("adverse_media", f"""{HITS} SELECT applicant_id, round(sum(weight), 2) AS raw_score, count(*) AS hit_count,
  count(DISTINCT keyword) AS keywords, round(sum(weight), 2) > 3.0 AS adverse_media_found FROM hits GROUP BY 1""")
def adverse_media(spark, sf_dir):
    return prose.adverse_media(media_hits(spark, sf_dir))


@query("shown_media_hits", f"""{HITS}, q AS (SELECT *, CAST(row_number() OVER (PARTITION BY applicant_id
  ORDER BY page_id, block_no, sentence_no, ord) AS INTEGER) AS rank FROM hits) SELECT * FROM q WHERE rank <= 10""")
def shown_media_hits(spark, sf_dir):
    return prose.shown_hits(media_hits(spark, sf_dir))


def pages(spark, sf_dir):
    site = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    rows = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    return rows.select("page_id", site.alias("applicant_id"), "html")


@query("html_blocks")
def html_blocks(spark, sf_dir):
    return reports.html_blocks(pages(spark, sf_dir), ("page_id", "applicant_id"))


@query("page_adverse_media")
def page_adverse_media(spark, sf_dir):
    blocks = reports.html_blocks(pages(spark, sf_dir), ("page_id", "applicant_id"))
    return prose.adverse_media(prose.adverse_hits(blocks, MEDIA, MITIGANTS))


# --- Pages and clean-up --------------------------------------------------------------
PAGES = View("page_rows", "conversations", ("conv_id AS doc_id", "CAST(turn + 1 AS INTEGER) AS page_number", "text"))


@query("assembled_pages", f"""WITH {PAGES.cte}
SELECT doc_id, string_agg('--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number)
  AS text, count(*) AS pages_extracted, count(*) FILTER (WHERE length(text) > 50) AS pages_with_content,
  CAST(sum(length(text)) AS BIGINT) AS total_characters,
  round(count(*) FILTER (WHERE length(text) > 50) / CAST(count(*) AS DOUBLE) * 100, 6) AS extraction_coverage
FROM page_rows GROUP BY doc_id""")
def assembled_pages(spark, sf_dir):
    return layout.assemble_pages(PAGES.frame(spark, sf_dir)).withColumn(
        "extraction_coverage", F.round("extraction_coverage", 6))


@query("document_kinds", f"""WITH {PAGES.cte}, m AS (SELECT doc_id, avg(length(text)) AS mean_chars FROM page_rows
  WHERE page_number <= 10 GROUP BY 1)
SELECT d.doc_id, round(mean_chars, 6) AS mean_chars, CASE WHEN mean_chars > 200 THEN 'text' ELSE 'scanned' END AS kind
FROM (SELECT doc_id FROM documents) d LEFT JOIN m USING (doc_id)""")
def document_kinds(spark, sf_dir):
    return layout.classify_docs(docs(spark, sf_dir), PAGES.frame(spark, sf_dir), least_mean=200.0).withColumn(
        "mean_chars", F.round("mean_chars", 6))


RAW = View("raw_docs", "documents", (
    "doc_id",
    "replace(replace(text, ', ', ',' || chr(10)), ' the ', ' t' || CASE WHEN doc_id % 2 = 0 THEN 'he ' ELSE 'he-' || "
    "chr(10) || ' ' END) || '-----' || chr(12) || '______' || chr(10) || chr(10) || chr(10) || chr(10) || 'Ende' AS text"))
CLEAN = f"""WITH {RAW.cte}, q AS (SELECT doc_id, regexp_replace(nfc_normalize(regexp_replace(regexp_replace(
  replace(text, chr(12), chr(10)), '-{{5,}}', '', 'g'), '_{{5,}}', '', 'g')), '([A-Za-z]{{2,}})-\\s*\\n\\s*([A-Za-z]{{2,}})',
  '\\1\\2', 'g') AS t FROM raw_docs),
l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS ls FROM q),
f AS (SELECT doc_id, ls, regexp_replace(array_to_string(list_transform(ls, lambda x, i: CASE WHEN length(x) > 0 AND
  length(x) < 80 AND NOT regexp_matches(x, '[.!?:;]$') AND i < len(ls) AND regexp_matches(coalesce(ls[i + 1], ''), '^\\p{{Ll}}')
  THEN '1' ELSE '0' END), ''), '1.', 'MS', 'g') AS plan FROM l)
SELECT doc_id, regexp_replace(array_to_string(list_filter(list_transform(ls, lambda x, i: CASE plan[i] WHEN 'M'
  THEN x || ' ' || ls[i + 1] WHEN 'S' THEN NULL ELSE x END), lambda x: x IS NOT NULL), chr(10)), '\\n{{3,}}',
  chr(10) || chr(10), 'g') AS text FROM f"""


@query("cleaned_text", CLEAN)
def cleaned_text(spark, sf_dir):
    return layout.clean_text(RAW.frame(spark, sf_dir))


# --- Headings and sections -----------------------------------------------------------
LINED = View("lined", "documents", (
    "doc_id",
    "'1. Business Overview' || chr(10) || text || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'RISK FACTORS' WHEN 1 THEN "
    "'Page 12' WHEN 2 THEN 'Cash Flow And Liquidity' WHEN 3 THEN '42' ELSE 'A. outlook' END || chr(10) || "
    "'one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen.' AS text"))
HEAD_WORDS = "|".join(tx.quote(k) for k in fv.HEADING_KEYWORDS)
HEADINGS = f"""WITH {LINED.cte}, ls AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: rtrim(x)) AS ls FROM lined),
u AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS raw FROM ls),
v AS (SELECT *, trim(raw) AS line, lead(raw) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM u),
w AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws,
  len(list_filter(string_split(coalesce(nxt, ''), ' '), lambda x: x <> '')) AS nn FROM v),
s AS (SELECT *, CASE WHEN upper(line) = line AND lower(line) <> line AND len(ws) >= 2 THEN 1 ELSE 2 END AS level,
  CASE WHEN length(line) >= 3 AND NOT regexp_matches(line, '^\\d+$') AND NOT regexp_matches(line, '^page\\s+\\d+', 'i') THEN
  CASE WHEN upper(line) = line AND lower(line) <> line AND len(ws) >= 2 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= len(ws) * CAST(0.7 AS DOUBLE) AND len(ws) >= 2
      THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN regexp_matches(lower(line), '{HEAD_WORDS}') THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN len(ws) <= 8 AND nn > 15 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN regexp_matches(line, '^(\\d+\\.?\\d*|[A-Z]\\.)\\s+\\w') THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  - CASE WHEN len(ws) > 12 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS confidence FROM w),
g AS (SELECT *, coalesce(confidence >= CAST(0.35 AS DOUBLE), false) AS head FROM s),
k AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM g)"""


@query("section_tree", f"""{HEADINGS}
SELECT doc_id, CAST(sec AS INTEGER) AS section_no, max(CASE WHEN head THEN line END) AS heading,
  max(CASE WHEN head THEN level END) AS level, round(max(CASE WHEN head THEN confidence END), 6) AS confidence,
  CAST(count(*) FILTER (WHERE NOT head AND line <> '') AS INTEGER) AS lines,
  coalesce(string_agg(line, '|' ORDER BY i) FILTER (WHERE NOT head AND line <> ''), '') AS content
FROM k WHERE sec > 0 GROUP BY doc_id, sec""")
def section_tree(spark, sf_dir):
    return layout.section_tree(LINED.frame(spark, sf_dir)).select(
        "doc_id", "section_no", "heading", "level", F.round("confidence", 6).alias("confidence"),
        F.size("content").alias("lines"), F.array_join("content", "|").alias("content"))


@query("line_neighbours", f"""WITH {LINED.cte}, ls AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: rtrim(x)) AS ls FROM lined),
u AS (SELECT doc_id, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM ls)
SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS "after" FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def line_neighbours(spark, sf_dir):
    return layout.with_neighbours(LINED.frame(spark, sf_dir))


LAYOUT_COLUMNS = (
    "doc_id", "line AS block_no", "CAST(floor(line / 4) + 1 AS INTEGER) AS page",
    "CAST(9 + (doc_id + line * 3) % 5 AS DOUBLE) AS font", "CAST((line % 4) * 120 AS DOUBLE) AS y",
    "CASE WHEN (doc_id + line) % 23 = 3 THEN 'Independent  Auditor''s Report' "
    "WHEN (doc_id + line) % 23 = 7 THEN 'Balance Sheet as at March' "
    "WHEN (doc_id + line) % 23 = 11 THEN 'Management Discussion and Analysis' "
    "WHEN (doc_id + line) % 23 = 15 THEN 'Report on Corporate Governance' "
    "WHEN (doc_id + line) % 23 = 19 THEN 'see the independent auditor' ELSE raw END AS text",
)


def layout_blocks(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    return lines.selectExpr(*[c.replace("''", "\\'") for c in LAYOUT_COLUMNS])


def section_cases(starts, ends):
    conf = lambda k: (
        "least(CAST(0.5 AS DOUBLE) + CASE WHEN norm = '{0}' THEN CAST(0.3 AS DOUBLE) WHEN norm LIKE '{0}%' OR norm LIKE '%{0}' "
        "THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END + CASE WHEN y < 150 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
        "+ CASE WHEN size < 50 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(1 AS DOUBLE))").format(k.replace("'", "''"))
    esc = lambda k: k.replace("'", "''")
    score = "CASE " + " ".join(f"WHEN head AND contains(norm, '{esc(k)}') THEN {conf(k)}" for k in starts) + " END"
    end = "head AND (" + " OR ".join(f"contains(norm, '{esc(k)}')" for k in ends) + ")"
    return score, end


MARKED = " UNION ALL ".join(
    f"SELECT doc_id, block_no, page, text, '{name}' AS section, {section_cases(a, b)[0]} AS score, "
    f"{'true' if name == fv.FALLBACK_SECTION else 'false'} AND contains(norm, '{fv.FALLBACK_PHRASE}') AS mentioned, "
    f"{section_cases(a, b)[1]} AS is_end FROM heads" for name, a, b in fv.SECTIONS)
SECTIONS = f"""WITH {DOCS.cte}, lr AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs),
ln AS (SELECT doc_id, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line, unnest(ls) AS raw FROM lr),
blocks AS (SELECT {", ".join(LAYOUT_COLUMNS)} FROM ln),
fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY font) AS rn, count(*) OVER (PARTITION BY doc_id, page) AS n
  FROM blocks), md AS (SELECT doc_id, page, font AS median_font FROM fr WHERE rn = n // 2 + 1),
heads AS (SELECT b.*, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, length(trim(text)) AS size,
  length(trim(text)) <= 150 AND font >= median_font * CAST(0.95 AS DOUBLE) AS head FROM blocks b JOIN md USING (doc_id, page)),
marked AS ({MARKED}),
st AS (SELECT doc_id, section, page, text, score, row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, block_no)
  AS rn FROM marked WHERE score IS NOT NULL),
fb AS (SELECT doc_id, section, page, text, row_number() OVER (PARTITION BY doc_id, section ORDER BY block_no) AS rn
  FROM marked WHERE mentioned),
chosen AS (SELECT doc_id, section, page AS start_page, text AS heading, score AS confidence FROM st WHERE rn = 1
  UNION ALL SELECT doc_id, section, page, text, CAST(0.5 AS DOUBLE) FROM fb WHERE rn = 1
  AND (doc_id, section) NOT IN (SELECT (doc_id, section) FROM st)),
found AS (SELECT c.doc_id, c.section, start_page, heading, confidence, coalesce(CAST(min(CASE WHEN m.is_end AND m.page > start_page
  THEN m.page END) - 1 AS INTEGER), start_page + 10) AS end_page FROM chosen c
  LEFT JOIN marked m ON m.doc_id = c.doc_id AND m.section = c.section GROUP BY c.doc_id, c.section, start_page, heading, confidence)"""


@query("sections_found", f"""{SECTIONS} SELECT doc_id, section, start_page, heading, round(confidence, 6) AS confidence, end_page
FROM found""")
def sections_found(spark, sf_dir):
    return layout.find_sections(layout_blocks(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("section_summary", f"""{SECTIONS} SELECT doc_id, section, start_page, end_page,
  CAST(end_page - start_page + 1 AS INTEGER) AS page_count, round(confidence, 3) AS confidence, heading AS detected_heading
FROM found""")
def section_summary(spark, sf_dir):
    return layout.section_summary(layout.find_sections(layout_blocks(spark, sf_dir)))


# Each page of the layout holds the text of its blocks.
SECTION_TEXTS = SECTIONS + """, pg AS (SELECT doc_id, page AS page_number, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY 1, 2),
texts AS (SELECT f.doc_id, f.section, string_agg('--- Page ' || page_number || ' ---' || chr(10) || p.text, chr(10) || chr(10) ORDER BY page_number) AS text,
  count(*) AS pages_extracted, count(*) FILTER (WHERE length(p.text) > 50) AS pages_with_content, CAST(sum(length(p.text)) AS BIGINT) AS total_characters
  FROM found f JOIN pg p ON p.doc_id = f.doc_id AND p.page_number BETWEEN f.start_page AND f.end_page GROUP BY 1, 2)"""


def section_texts_of(spark, sf_dir):
    blocks = settle(layout_blocks(spark, sf_dir))
    on_page = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    pages = blocks.groupBy("doc_id", F.col("page").alias("page_number")).agg(
        F.array_join(F.transform(on_page, lambda b: b["text"]), "\n").alias("text"))
    return layout.section_texts(pages, layout.find_sections(blocks))


@query("section_texts", f"{SECTION_TEXTS} SELECT doc_id, section, md5(text) AS text_md5, pages_extracted, pages_with_content, total_characters FROM texts")
def section_texts(spark, sf_dir):
    return section_texts_of(spark, sf_dir).select(
        "doc_id", "section", F.md5("text").alias("text_md5"), "pages_extracted", "pages_with_content", "total_characters")


@query("section_tone", SECTION_TEXTS + f""", l AS (SELECT doc_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low
  FROM texts WHERE section = 'mda_report'), w AS (SELECT *, {WORDS.format("low")} AS ws FROM l),
c AS (SELECT doc_id, length(trim(text)) >= 100 AS ok, len(ws) AS n, {count_sql(TONE["negative"])} AS neg, {count_sql(TONE["positive"])} AS pos FROM w)
SELECT doc_id, CAST(n AS INTEGER) AS total_words, CAST(neg AS INTEGER) AS negative_words, CAST(pos AS INTEGER) AS positive_words,
  CASE WHEN ok THEN round((pos - neg) / CAST(n AS DOUBLE), 4) ELSE 0.0 END AS sentiment_score FROM c""")
def section_tone(spark, sf_dir):
    talked = section_texts_of(spark, sf_dir).filter("section = 'mda_report'").select("doc_id", "text")
    return prose.lexicon_sentiment(talked, TONE).select("doc_id", "total_words", "negative_words", "positive_words", "sentiment_score")


# --- Entity names --------------------------------------------------------------------
COVERS = View("covers", "documents", (
    "doc_id",
    "CASE doc_id % 4 WHEN 0 THEN 'Alpha_' || CAST(doc_id AS STRING) || '_Pvt_Ltd._Annual_Report_2021.pdf' "
    "WHEN 1 THEN 'AnnualReport_2019CDEL.pdf' WHEN 2 THEN 'AnnualReport_2019TCS.pdf' ELSE 'annual_report_2020.pdf' END AS file_name",
    "CASE WHEN doc_id % 4 = 1 THEN 'FY20' || chr(10) || 'Beta Works ' || CAST(doc_id AS STRING) || ' Limited' || chr(10) || "
    "'2019-20' || chr(10) || 'Annual Report' || chr(10) || text ELSE text END AS first_page",
    "CASE WHEN doc_id % 8 = 3 THEN 'GAMMA HOLDINGS' END AS registry_name",
    "CASE WHEN doc_id % 8 = 7 THEN 'Delta Mills' END AS fallback_name"))
NAMES = f"""WITH {COVERS.cte}, named AS (SELECT doc_id, registry_name, fallback_name, CASE doc_id % 4
  WHEN 0 THEN 'Alpha ' || doc_id WHEN 1 THEN 'Beta Works ' || doc_id WHEN 2 THEN 'Tata Consultancy Services'
  ELSE 'annual_report_2020' END AS entity_name FROM covers)"""


@query("entity_names", f"{NAMES} SELECT doc_id, registry_name, fallback_name, entity_name FROM named")
def entity_names(spark, sf_dir):
    return layout.entity_name(COVERS.frame(spark, sf_dir), numbered=True)


@query("resolved_names", f"""{NAMES} SELECT doc_id, CASE WHEN doc_id % 8 = 3 THEN 'Gamma Holdings'
  WHEN doc_id % 8 = 7 THEN 'Delta Mills' ELSE entity_name END AS resolved_name FROM named""")
def resolved_names(spark, sf_dir):
    return layout.resolve_name(layout.entity_name(COVERS.frame(spark, sf_dir), numbered=True)).select("doc_id", "resolved_name")


@query("title_candidates", f"""WITH {COVERS.cte} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN NULL END AS candidate,
  doc_id % 4 = 1 AS has_title FROM covers""".replace("CASE WHEN doc_id % 4 = 1 THEN NULL END AS candidate,\n ", ""))
def title_candidates(spark, sf_dir):
    rows = COVERS.frame(spark, sf_dir).withColumn("first_page", F.when(F.col("first_page").startswith("FY20"), F.replace(
        "first_page", F.lit("2019-20\n"))).otherwise(F.col("first_page")))
    return rows.select("doc_id", F.coalesce(layout.title_candidate(F.col("first_page")).isNotNull(), F.lit(False)).alias("has_title"))
