"""From pages and documents to blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship
from .dom import collapse, collapse_sql, page_blocks, unescape_closed, unescape_sql

BLOCK = "struct<type: string, text: string, index: int, heading_path: array<string>>"
_KINDS = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("index", pa.int32()), ("heading_path", pa.list_(pa.string()))]))


def _parse(batches: Iterator[pa.RecordBatch], closed: bool = False, sql: bool = False) -> Iterator[pa.RecordBatch]:
    decode = unescape_sql if sql else unescape_closed if closed else unescape
    squeeze = collapse_sql if sql else collapse
    for batch in batches:
        selectors, blocks = [], []
        for html in batch.column("html").to_pylist():
            selector, found = page_blocks(html, decode, squeeze)
            selectors.append(selector)
            blocks.append([vars(b) for b in found])
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("title"), pa.array(selectors, pa.string()), pa.array(blocks, _KINDS)], ["page_id", "url", "title", "selector", "blocks"])


def parsed_pages(pages: DataFrame, closed: bool = False, sql: bool = False) -> DataFrame:
    """page_id, url, title, selector, blocks: html is parsed once a page, in
    Arrow batches, and goes no further. ``closed``: character references count
    only with their semicolon, not as browsers take them; ``sql``: references and white space as the SQL has them."""
    ship(pages.sparkSession)
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", text.title(F.col("html")).alias("title"))
    return wanted.mapInArrow(partial(_parse, closed=closed, sql=sql), f"page_id long, url string, title string, selector string, blocks array<{BLOCK}>")


def document_blocks(docs: DataFrame, sql: bool = False) -> DataFrame:
    """page_id and blocks of plain texts: each line with something in it is a paragraph."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: text.collapse(x, sql)), lambda x: x != "")
    made = F.transform(lines, lambda x, i: F.struct(F.lit("p").alias("type"), x.alias("text"), i.alias("index"), F.array().cast("array<string>").alias("heading_path")))
    return docs.select(F.col("doc_id").alias("page_id"), made.alias("blocks"))


def read_whole(spark, path: str) -> DataFrame:
    """Local or remote HTML files as pages, one a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", "html")
