"""Search: from hits and fetched pages to ranked, budgeted excerpts per query.

All filters on hits run before pages are joined, so that no page is fetched or
parsed in vain. hits: query_id, ordinal, url, title, content, score, engine.
pages: page_id, url, html, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Search
from ..functions import text, urls
from ..functions.stem import stemmed
from ..operators import render
from ..session import materialize
from ..sources.pages import parsed_pages
from .extract import extract_parsed

# Weights of a page's relevance, and the least rest of a budget worth a part of a page.
PAGE_WEIGHTS = {"title": 0.35, "url": 0.15, "excerpt": 0.35, "score": 0.15}
LEAST_REST = 200
MOST_BLOCKED, MOST_FILTERED = 3, 5


def queries(raw: DataFrame, stem: bool = True) -> DataFrame:
    """query_id, search_query, query (without operators) and q from query_id, search_query."""
    rows = raw.withColumn("query", urls.without_operators(F.col("search_query")))
    words = text.tokens(F.col("query"))
    return rows.withColumn("q", stemmed(words) if stem else words)


def first_of_each(hits: DataFrame) -> DataFrame:
    """Of hits with one normal form of URL, the first in the backend's order."""
    w = Window.partitionBy("query_id", urls.dedup_key(F.col("url"))).orderBy("ordinal")
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def pool(stem: bool = True) -> Column:
    """Distinct tokens of title, snippet and URL path."""
    words = F.array_distinct(F.concat(text.tokens(F.col("title")), text.tokens(F.col("content")), urls.path_words(F.col("url"))))
    return stemmed(words) if stem else words


def title_match() -> Column:
    """Share of q's tokens in ``pool``; without a query all match."""
    return F.when(F.size("q") == 0, F.lit(1.0)).otherwise(text.overlap(F.col("q"), F.col("pool")))


def by_locale(url: Column) -> Column:
    return F.collate(url, "UNICODE")


def chosen_hits(hits: DataFrame, asked: DataFrame, c: Search = Search(), seen: DataFrame | None = None, stem: bool = True) -> DataFrame:
    """Every unique hit with its status: wanted (then place counts from 1),
    blocked_js, title_filtered or session_cached; the rest beyond the limit goes.
    seen: (query_id, key) already returned in the query's session."""
    known = hits.select(
        "query_id", "ordinal", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("score", F.lit(1.0)).alias("score"),
    ).where(F.col("ordinal") < c.over_fetch * c.max_results)
    # written out, since stems come from Python and are compared in a lambda
    pooled = materialize(first_of_each(known).join(asked.select("query_id", "q"), "query_id").withColumn("pool", pool(stem)), "pooled")
    judged = pooled.withColumn("coverage", title_match()).drop("pool")
    judged = judged.withColumn("status", F.when(urls.is_blocked(F.col("url")), "blocked_js").when(F.col("coverage") < c.min_title_match, "title_filtered").otherwise("wanted"))
    order = Window.partitionBy("query_id", "status").orderBy(F.col("score").desc(), by_locale(F.col("url")))
    numbered = judged.withColumn("place", F.row_number().over(order)).where((F.col("status") != "wanted") | (F.col("place") <= c.max_results))
    if seen is None:
        return numbered
    keyed = numbered.withColumn("key", urls.session_key(F.col("url"), F.col("q")))
    old = keyed.join(seen.select("query_id", "key").distinct().withColumn("old", F.lit(True)), ["query_id", "key"], "left")
    return old.withColumn("status", F.when((F.col("status") == "wanted") & F.col("old"), "session_cached").otherwise(F.col("status"))).drop("key", "old")


def relevance_tokens(rows: DataFrame, stem: bool = True, sql: bool = False) -> DataFrame:
    """Adds title_tokens and path_tokens of title and url."""
    title, path = text.tokens(F.col("title"), sql=sql), urls.path_words(F.col("url"), sql)
    return rows.withColumns({"title_tokens": stemmed(title) if stem else title, "path_tokens": stemmed(path) if stem else path})


def page_relevance() -> Column:
    """From title_tokens, path_tokens, q, best (excerpt score) and score."""
    w = PAGE_WEIGHTS
    return (
        w["title"] * text.overlap(F.col("q"), F.col("title_tokens"))
        + w["url"] * text.overlap(F.col("q"), F.col("path_tokens"))
        + w["excerpt"] * F.coalesce("best", F.lit(0.0))
        + w["score"] * F.least(F.coalesce("score", F.lit(0.0)) / 10, F.lit(1.0))
    )


def page_budget(pages: DataFrame, total: int) -> DataFrame:
    """Adds ``kept`` (structs of excerpts, none: over budget) to ranked pages with
    query_id, page_rank, chars and parts (structs with text and char_count).

    Pages are whole until the first that overflows; of that one, if enough is
    left, excerpts that fit by their formatted length; nothing after it."""
    w = Window.partitionBy("query_id").orderBy("page_rank")
    before = F.coalesce(F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ran = pages.withColumn("before", before).withColumn("over", (F.col("before") + F.col("chars") > total).cast("int"))
    ran = ran.withColumn("n_over", F.sum("over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = total - F.col("before")
    fits = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("used"), F.expr("slice(parts, 1, 0)").alias("out")),
        lambda acc, x: F.when(
            acc["used"] + text.utf16_length(x["text"]) <= left,
            F.struct((acc["used"] + text.utf16_length(x["text"])).cast("long").alias("used"), F.concat(acc["out"], F.array(x)).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    none = F.expr("slice(parts, 1, 0)")
    kept = F.when(F.col("n_over") == 0, F.col("parts")).when((F.col("n_over") == 1) & (F.col("over") == 1) & (left > LEAST_REST), fits).otherwise(none)
    return ran.withColumn("kept", kept).drop("before", "over", "n_over")


def status(html_missing: Column) -> Column:
    """Of a wanted hit that was fetched: from its excerpts and metrics."""
    return (
        F.when(html_missing, "scrape_failed")
        .when(F.col("excerpt_count") > 0, "success")
        .when(F.col("reject_reason").isNotNull(), "low_quality")
        .when(~F.col("relevant"), "not_relevant")
        .otherwise("no_content")
    )


def search_tables(raw_queries: DataFrame, hits: DataFrame, pages: DataFrame, c: Search = Search(), seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept pages, diagnostics, session keys) of all queries."""
    stem = c.extraction.stem
    asked = materialize(queries(raw_queries, stem), "queries")
    chosen = materialize(chosen_hits(hits, asked, c, seen, stem), "hits")
    wanted = chosen.where("status = 'wanted'")
    fetched = wanted.select("url").distinct().join(pages, "url").withColumn("missing", F.col("html").isNull())
    parsed = materialize(parsed_pages(fetched.where(~F.col("missing"))), "parsed")
    titles = materialize(relevance_tokens(wanted.drop("coverage").join(fetched.select("url", "page_id", "missing", "error"), "url"), stem), "titles")
    cfg = c.extraction.merged(excerpts={"char_budget": c.per_page_chars})
    found, metrics = extract_parsed(parsed, asked.select("query_id", "query", "q"), cfg, titles.where(~F.col("missing")).select("query_id", "page_id"))
    per_page = found.groupBy("query_id", "page_id").agg(
        F.count("*").alias("excerpt_count"), F.sum("char_count").alias("char_count"), F.max("score").alias("best"),
        F.sort_array(F.collect_list(F.struct("excerpt", "text", "heading_path", "char_count"))).alias("parts"),
    )
    keys = ["query_id", "page_id"]
    joined = titles.join(per_page, keys, "left").join(metrics, keys, "left").withColumn("excerpt_count", F.coalesce("excerpt_count", F.lit(0)))
    joined = materialize(joined.withColumn("status", status(F.col("missing"))).withColumn("relevance", page_relevance()), "joined")
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), by_locale(F.col("url")))
    ranked = joined.where("status = 'success'").withColumn("page_rank", F.row_number().over(order)).withColumn("chars", F.col("char_count"))
    budgeted = materialize(page_budget(ranked, c.total_chars), "budgeted")
    kept = budgeted.where(F.size("kept") > 0)
    over = budgeted.where(F.size("kept") == 0).select(*keys, F.lit(True).alias("over"))
    own = joined.join(over, keys, "left").withColumn("status", F.when(F.col("over"), "budget_exceeded").otherwise(F.col("status")))
    line = ["query_id", "part", "place", "url", "title", "status", "error", "excerpt_count", "char_count", "coverage", "max_bm25"]
    tried = own.select(
        "query_id", F.lit(3).alias("part"), "place", "url", "title", "status", F.coalesce("error", "reject_reason").alias("error"),
        "excerpt_count", "char_count", "coverage", "max_bm25",
    )
    return kept, _diagnostics(chosen, tried, line), wanted.select("query_id", urls.session_key(F.col("url"), F.col("q")).alias("key"))


def _diagnostics(chosen: DataFrame, tried: DataFrame, line: list[str]) -> DataFrame:
    """Blocked, cached and filtered hits (some of them) before those that were tried."""
    part = F.create_map(F.lit("blocked_js"), F.lit(0), F.lit("session_cached"), F.lit(1), F.lit("title_filtered"), F.lit(2))
    most = F.when(F.col("status") == "blocked_js", MOST_BLOCKED).when(F.col("status") == "title_filtered", MOST_FILTERED).otherwise(2**31 - 1)
    skipped = chosen.where("status <> 'wanted'").where(F.col("place") <= most)
    none = {"error": "string", "excerpt_count": "int", "char_count": "long", "max_bm25": "double"}
    skipped = skipped.withColumns({"part": F.try_element_at(part, F.col("status")), **{k: F.lit(None).cast(t) for k, t in none.items()}})
    return skipped.select(*line).unionByName(tried.select(*line))


def search(raw_queries: DataFrame, hits: DataFrame, pages: DataFrame, c: Search = Search(), seen: DataFrame | None = None, diagnostics: bool = False) -> DataFrame:
    """query_id, result: the rendered answer to each query."""
    kept, lines, _ = search_tables(raw_queries, hits, pages, c, seen)
    asked = queries(raw_queries, c.extraction.stem).select("query_id", "q")
    section = kept.select("query_id", "page_rank", "title", "url", F.col("kept").alias("parts")).withColumn("section", render.page_section())
    sections = section.groupBy("query_id").agg(F.count("*").alias("n_kept"), F.sort_array(F.collect_list(F.struct("page_rank", "section")))["section"].alias("sections"))
    lines = materialize(lines, "diagnostics")
    said = lines.withColumn("line", render.status_line()).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "place", "line")))["line"].alias("lines"), F.count_if(F.col("part") == 3).alias("n_tried"), F.count_if(F.col("part") == 1).alias("n_skipped")
    )
    tips = render.status_counts(lines).join(asked, "query_id").select("query_id", render.suggestions().alias("tips"))
    whole = asked.join(said, "query_id", "left").join(sections, "query_id", "left").join(tips, "query_id", "left")
    empty = F.array().cast("array<string>")
    whole = whole.withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in ("n_kept", "n_tried", "n_skipped")} | {k: F.coalesce(k, empty) for k in ("sections", "lines", "tips")})
    return whole.select("query_id", render.result_text(diagnostics).alias("result"))
