"""One page's content: whole as Markdown, or the excerpts for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FETCH, Extraction
from ..functions import text, urls
from ..operators import render
from ..session import materialize
from ..sources.pages import parsed_pages
from .extract import extract_parsed, query_table

BUDGET = 12_000


def _head() -> Column:
    name = F.when(F.col("title") == "", urls.domain(F.col("url"))).otherwise(F.col("title"))
    return F.concat(F.lit("# "), name, F.lit("\nSource: "), F.col("url"), F.lit("\n\n"))


def _failed(pages: DataFrame) -> DataFrame:
    why = F.coalesce(F.col("error") if "error" in pages.columns else F.lit(None).cast("string"), F.lit("Failed to fetch page"))
    return pages.where("html is null").select("page_id", F.concat(F.lit("Error fetching "), F.col("url"), F.lit(": "), why).alias("content"))


def fetch_pages(pages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """page_id, content: every page in full, as Markdown within the budget."""
    parsed = parsed_pages(pages.where("html is not null"))
    body = (
        F.when(F.col("selector").isNull(), F.lit("Could not extract main content from page."))
        .when(F.size("blocks") == 0, F.lit("No content blocks found on page."))
        .otherwise(render.markdown(F.col("blocks"), budget))
    )
    return parsed.select("page_id", text.trim(F.concat(_head(), body)).alias("content")).unionByName(_failed(pages))


def fetch_for(pages: DataFrame, query: str, budget: int = BUDGET, c: Extraction = FETCH) -> DataFrame:
    """page_id, content: what every page says about the query."""
    spark = pages.sparkSession
    parsed = materialize(parsed_pages(pages.where("html is not null")), "parsed")
    found, _ = extract_parsed(parsed, query_table(spark, [(0, query)], c.stem), c.merged(excerpts={"char_budget": budget}))
    one = F.concat(F.when(F.size("heading_path") > 0, F.concat(F.lit("> "), F.array_join("heading_path", " > "), F.lit("\n"))).otherwise(""), "text", F.lit("\n"))
    parts = found.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("excerpt", one.alias("one"))))["one"], "\n").alias("body"))
    body = F.coalesce("body", F.lit(f'No relevant content found for query "{query}".'))
    return parsed.select("page_id", "url", "title").join(parts, "page_id", "left").select("page_id", text.trim(F.concat(_head(), body)).alias("content")).unionByName(_failed(pages))
