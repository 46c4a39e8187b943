"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is the path of element labels (tag, class and
id words). Per node the tree holds how pages present it (runs of child labels) and what they show
below it (block texts). With m different pages that have the node, p the share of a presentation
and c the pages that show a text:

  presentation importance  -sum(p * log_m(p))         differing layouts matter
  content importance       mean of 1 - log_m(c)       texts of one page matter, texts of all pages don't
  importance               (1 - GAMMA) * presentation + GAMMA * content

Branches below ``least`` are removed from every page, if at least ``MIN_PAGES`` different pages of
the host have them, but none that is unmarked and in an article or main element. Elements whose tag, role, class or id names them as page furniture go in any
case, as comments differ by page and small hosts have no statistics. Class and id words say nothing
about html, body, main, an article, an element around main or the page's longest article, one with
most of the page's text, or headings and table rows in an article. A form or an aside without an end
tag is furniture unless it holds these. If a page has an article (else a main) element with text left,
only what lies in it stays, unless there is more prose (blocks of ``PROSE`` characters on) beside
its articles than in the longest of them: then these are cards, and what lies beside them (in the
main element, if there) stays.

Pages are read twice, as keeping their blocks would cost more than parsing them again; only hashed
statistics are shuffled, combined per task. Nodes to remove are sent to the pages if a count shows
them to be few, else pages meet them in shares of their host. Copies of an article count once: pages are one if they
show the same unmarked text in their article (else main) element or, without such text, in blocks
of ``PROSE`` characters on, or else in all blocks; so menus, adverts and dates make no other page. Null html is empty
text; a page without url belongs to the host ''. Repeated rows are extracted alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.frames import BROADCAST_ROWS, settled, small_batches
from lendgrain.llm.html_blocks import Block, ancestors, blocks_of
from lendgrain.session import settle

GAMMA, LEAST, MIN_PAGES, PROSE, SHARES = 0.9, 0.5, 8, 80, 64


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def told(blocks: list[Block]) -> list[str]:
    """Texts that make a page another one than its neighbours."""
    unmarked = [b for b in blocks if not b.furniture]
    parts = [[b for b in unmarked if b.within == kind] for kind in ("article", "main")]
    parts += [[b for b in unmarked if len(b.text) >= PROSE], unmarked, blocks]
    return [b.text for b in next((part for part in parts if part), [])]


def chosen(blocks: list[Block], low: set[int]) -> list[str]:
    """Texts that stay, given the hashed paths of low importance."""
    verdicts: dict[str, bool] = {}
    for path in {b.path for b in blocks}:
        verdicts[path] = not low or not any(_hash(p) in low for p in ancestors(path))
    left = [b for b in blocks if not b.furniture and (b.within or verdicts[b.path])]
    beside = [b for b in left if b.within != "article"]
    prose = lambda some: sum(len(b.text) for b in some if len(b.text) >= PROSE)
    articles = Counter()
    for b in left:
        if b.within == "article":
            articles[b.article] += prose([b])
    if articles and max(articles.values()) >= prose(beside):
        return [b.text for b in left if b.within == "article"]
    inside = [b.text for b in beside if b.within == "main"]
    return inside or [b.text for b in beside]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: host, hash of the texts that tell it, hash of all facts, and hashed (node, kind, value) facts.

    Kinds: 0 a node's presentation, 1 a text right in it, 2 a node below it that has texts.
    """
    fact = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())])
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("copy", pa.int64()), ("facts", pa.list_(fact))])
    for batch in batches:
        rows = []
        for html in batch.column("html").to_pylist():
            blocks, styles = blocks_of(html or "")
            facts = {(path, 0, style) for path, style in styles.items() if path}
            facts |= {(b.path, 1, b.text) for b in blocks}
            facts |= {(above, 2, path) for path in {b.path for b in blocks} for above in ancestors(path)}
            hashed = [{"node": _hash(n), "kind": k, "value": _hash(v)} for n, k, v in facts]
            copy = _hash(str(sum(hash((f["node"], f["kind"], f["value"])) for f in hashed)))
            rows.append((_hash("\n".join(told(blocks))), copy, hashed))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), *[pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(3)]],
            schema=schema)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of every node, from pages (host, html)."""
    facts = pages.select("host", "html").mapInArrow(
        _facts, "host string, page long, copy long, facts array<struct<node: long, kind: int, value: long>>")
    seen = facts.groupBy("host", "page").agg(F.min_by("facts", "copy").alias("facts")).select("host", F.inline("facts"))
    values = settled(seen.groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).alias("c")))
    sizes = values.filter("kind = 0").groupBy("host", "node").agg(
        F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("c_log_c"))
    texts = values.filter("kind = 1").groupBy("host", "node").agg(
        F.sum(F.log("c")).alias("logs"), F.count(F.lit(1)).alias("texts")).withColumnRenamed("node", "value")
    content = values.filter("kind = 2").select("host", "node", "value").join(texts, ["host", "value"]).groupBy(
        "host", "node").agg((F.sum("logs") / F.sum("texts")).alias("mean_log"))
    log_m = F.log("pages")
    presentation = (log_m - F.col("c_log_c") / F.col("pages")) / log_m
    shown = 1 - F.coalesce(F.col("mean_log"), log_m) / log_m
    importance = F.when(F.col("pages") > 1, (1 - GAMMA) * presentation + GAMMA * shown).otherwise(1.0)
    return sizes.join(content, ["host", "node"], "left").select("host", "node", "pages", importance.alias("importance"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in batches:
        texts = []
        for html, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist()):
            texts.append("\n".join(chosen(blocks_of(html or "")[0], set(low or ()))))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], schema=schema)


def main_texts(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, url and text, its blocks joined by newlines."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    pages = small_batches(pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host.alias("host")))
    tree = style_tree(pages).filter((F.col("pages") >= min_pages) & (F.col("importance") < least))
    low = settle(tree.groupBy("host").agg(F.collect_list("node").alias("low")))
    nodes = low.agg(F.sum(F.size("low") + 1)).first()[0] or 0
    if nodes <= BROADCAST_ROWS:
        joined = pages.join(F.broadcast(low), "host", "left")
    else:
        share = F.pmod(F.xxhash64("page_id", "url"), F.lit(SHARES).cast("long")).alias("share")
        every = low.select("host", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"))
        joined = pages.select("*", share).join(every, ["host", "share"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(
        _texts, "page_id long, url string, text string")
