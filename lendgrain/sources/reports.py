"""Report text files and web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements that hold text blocks, elements without text of interest, and
# elements that never have an end tag.
BLOCK_TAGS = {"p", "span", "li", "div", "a"}
SILENT_TAGS = {"script", "style", "noscript"}
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
PAGES_AT_ONCE = 100
LEAST_BLOCK = 40


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file, named after the file."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


class BlockReader(HTMLParser):
    """Text of every block element of one page, in order of their start tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = []
        self.open: list[tuple[str, list[str] | None]] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID_TAGS:
            return
        block = [] if tag in BLOCK_TAGS and not self.silent else None
        if block is not None:
            self.blocks.append(block)
        self.open.append((tag, block))
        self.silent += tag in SILENT_TAGS

    def handle_endtag(self, tag: str) -> None:
        if not any(name == tag for name, _ in self.open):
            return
        while True:
            name, _ = self.open.pop()
            self.silent -= name in SILENT_TAGS
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if piece and not self.silent:
            for _, block in self.open:
                if block is not None:
                    block.append(piece)


def page_blocks(html: str) -> list[str]:
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    return [text.lower() for text in (" ".join(block) for block in reader.blocks) if len(text) > LEAST_BLOCK]


def html_blocks(pages: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Lowercase text blocks of each page, nested blocks included.

    Nested tags need a parser, which runs on Arrow batches inside the tasks, ``PAGES_AT_ONCE`` pages at a time:
    a batch may hold 10,000 pages, and only the texts of a slice are Python objects at once.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                found = [page_blocks(h or "") for h in part.column("html").to_pylist()]
                owner = pa.array([n for n, blocks in enumerate(found) for _ in blocks], pa.int64())
                numbers = pa.array([n for blocks in found for n in range(len(blocks))], pa.int32())
                texts = pa.array([text for blocks in found for text in blocks], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(owner) for k in keys], numbers, texts], [*keys, "block_no", "text"])

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block_no int, text string"
    return pages.select(*keys, "html").mapInArrow(parse, schema)
