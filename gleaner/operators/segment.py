"""From blocks to sentences with their places and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Tokens
from ..functions import text
from ..functions.stem import stemmed

_SENTENCE = "array<struct<block_index: int, sentence_index: int, text: string, heading_path: array<string>, position: double, block_type: string>>"


def is_heading(kind: Column) -> Column:
    return kind.rlike(r"^h[1-6]\z")


def heading_level(kind: Column) -> Column:
    return F.when(is_heading(kind), F.substring(kind, 2, 1).cast("int"))


def block_sentences(block: Column, sql: bool = False) -> Column:
    """Texts of one block: headings and code are one sentence each."""
    return (
        F.when(is_heading(block["type"]), F.array(block["text"]))
        .when(block["type"] == "pre", F.array(text.clean_code(block["text"])))
        .otherwise(text.sentences(block["text"], sql))
    )


def page_sentences(blocks: Column, sql: bool = False) -> Column:
    """All sentences of a page, as an array: no shuffle is needed to number them."""
    last = F.nullif(F.size(blocks) - 1, F.lit(0))
    found = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                block_sentences(b, sql),
                lambda s, i: F.struct(
                    b["index"].alias("block_index"), i.alias("sentence_index"), s.alias("text"), b["heading_path"].alias("heading_path"),
                    F.coalesce(b["index"] / last, F.lit(0.0)).alias("position"), b["type"].alias("block_type"),
                ),
            ),
        )
    )
    return F.filter(found, lambda s: s["text"] != "")


def sentences(pages: DataFrame, stem: bool = True, keep: tuple[str, ...] = ("page_id",), tokens: Tokens = Tokens(), sql: bool = False) -> DataFrame:
    """One row a sentence: global_index counts from 0 within the page. ``sql``: see functions.text."""
    rows = pages.select(*keep, F.posexplode(page_sentences(F.col("blocks"), sql)).alias("global_index", "s")).select(*keep, "global_index", "s.*")
    words = text.tokens(F.col("text"), tokens.stop_words, tokens.min_length, sql)
    return rows.withColumn("tokens", stemmed(words) if stem else words)
