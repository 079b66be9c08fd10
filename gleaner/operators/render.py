"""Text renderings of excerpts, search results, diagnostics and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls


def _join(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def excerpt_report(excerpts: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, page_id, report: a header and the numbered excerpts."""
    one = F.concat(
        F.format_string("--- Excerpt %d (score: %.3f, %d chars) ---\n", F.col("excerpt") + 1, F.col("score"), F.col("char_count")),
        F.when(F.size("heading_path") > 0, F.concat(F.lit("["), F.array_join("heading_path", " > "), F.lit("]\n"))).otherwise(""),
        "text",
        F.lit("\n"),
    )
    made = excerpts.groupBy("query_id", "page_id").agg(F.sum("char_count").alias("total"), F.sort_array(F.collect_list(F.struct("excerpt", one.alias("one")))).alias("parts"))
    head = F.concat(F.lit('Query: "'), F.col("query"), F.lit('"\nTotal characters: '), F.col("total").cast("string"), F.lit("\n\n"))
    return made.join(queries, "query_id").select("query_id", "page_id", F.concat(head, _join(F.col("parts")["one"])).alias("report"))


def percent(share: Column) -> Column:
    return F.format_string("%.0f", F.coalesce(share, F.lit(0.0)) * 100)


def status_line(c: DataFrame | None = None) -> Column:
    """One diagnostic line from url, status, error, excerpt_count, char_count, coverage and max_bm25."""
    name = F.concat(F.lit("["), urls.short(F.col("url")), F.lit("] "))
    said = {
        "success": ("+", F.format_string("%d excerpt(s), %d chars", F.col("excerpt_count"), F.col("char_count"))),
        "scrape_failed": ("-", F.concat(F.lit("FAILED: "), F.coalesce("error", F.lit("Could not fetch page")))),
        "no_content": ("-", F.lit("SKIPPED: No extractable content")),
        "not_relevant": ("-", F.concat(F.lit("SKIPPED: Not relevant ("), percent(F.col("coverage")), F.format_string("%% terms, score: %.2f)", F.coalesce("max_bm25", F.lit(0.0))))),
        "budget_exceeded": ("~", F.lit("TRUNCATED: Output limit reached")),
        "blocked_js": ("x", F.lit("SKIPPED: JS-rendered site")),
        "low_quality": ("x", F.concat(F.lit("SKIPPED: "), F.coalesce("error", F.lit("Low quality content")))),
        "session_cached": ("=", F.lit("SKIPPED: Already fetched in this session")),
        "title_filtered": ("x", F.concat(F.lit("SKIPPED: Low title/snippet relevance ("), percent(F.col("coverage")), F.lit("% match)"))),
    }
    other = F.concat(F.lit("? "), name, F.lit("Unknown status"))
    return reduce(lambda rest, s: F.when(F.col("status") == s[0], F.concat(F.lit(s[1][0] + " "), name, s[1][1])).otherwise(rest), reversed(said.items()), other)


STATUSES = ["success", "not_relevant", "no_content", "scrape_failed", "budget_exceeded", "blocked_js", "low_quality", "session_cached", "title_filtered"]


def status_counts(diagnostics: DataFrame) -> DataFrame:
    """One row a query: a count for each status, and not_relevant pages' mean coverage."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    far = F.avg(F.when(F.col("status") == "not_relevant", F.coalesce("coverage", F.lit(0.0))))
    return diagnostics.groupBy("query_id").agg(F.count("*").alias("n"), *counts, far.alias("mean_coverage"))


def suggestions() -> Column:
    """Advice from a row of ``status_counts`` and the query's tokens q."""
    c = F.col
    tried = c("n") - c("n_session_cached") - c("n_title_filtered")

    def note(test: Column, words: Column | str) -> Column:
        return F.when(test, F.lit(words) if isinstance(words, str) else words)

    nothing = F.array(
        F.lit("NO RESULTS EXTRACTED. Your query may be too vague or not match the content."),
        F.lit("Try a more specific query with exact library names, function names, or error messages."),
        F.concat(F.lit("Current query tokens: ["), F.array_join("q", ", "), F.lit("] - ensure these terms appear in documentation you're looking for.")),
        note(c("n_blocked_js") > 0, F.format_string("%d result(s) from Stack Overflow/GitHub were skipped (JavaScript-rendered sites not supported).", c("n_blocked_js"))),
    )
    some = F.array(
        note((tried > 0) & (c("n_success") < tried / 2), F.format_string("Only %d/%d pages had relevant content.", c("n_success"), tried)),
        note((c("n_not_relevant") >= 2) & (c("mean_coverage") < 0.3), "Query terms not found on many pages. Try adding the exact library/framework name (e.g., 'React', 'Next.js', 'Express')."),
        note((c("n_not_relevant") >= 2) & (c("mean_coverage") >= 0.3), "Pages contained some query terms but lacked focused content. Try adding method names or error codes."),
        note(c("n_scrape_failed") >= 2, "Multiple pages failed to load. This is normal for paywalled or bot-protected sites."),
        note(c("n_no_content") >= 2, "Multiple pages had no extractable content. These may require login or have unusual page structures."),
        note(c("n_budget_exceeded") > 0, F.format_string("%d additional page(s) had content but were omitted due to output size limits.", c("n_budget_exceeded"))),
        note(c("n_blocked_js") > 0, F.format_string("%d result(s) from Stack Overflow/GitHub were skipped (JavaScript-rendered).", c("n_blocked_js"))),
        note(c("n_low_quality") > 0, F.format_string("%d page(s) had low quality content (mostly metadata or fragments).", c("n_low_quality"))),
        note(c("n_session_cached") > 0, F.format_string("%d page(s) were skipped (already fetched earlier in this session).", c("n_session_cached"))),
        note(c("n_title_filtered") > 0, F.format_string("%d result(s) were skipped (title/snippet didn't match query terms).", c("n_title_filtered"))),
    )
    return F.array_compact(F.when((c("n_success") == 0) & (tried > 0), nothing).otherwise(some))


def page_section() -> Column:
    """A page of a result: a link, then each excerpt under its headings. Needs
    title, url and parts (structs of heading_path and text, in order)."""
    one = F.transform("parts", lambda x: F.concat(F.when(F.size(x["heading_path"]) > 0, F.concat(F.lit("> "), F.array_join(x["heading_path"], " > "), F.lit("\n"))).otherwise(""), x["text"]))
    return F.concat(F.lit("\n---\n\n## ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")\n"), _join(one))


def result_text(diagnostics: bool) -> Column:
    """A query's whole result from n_kept, n_tried, n_skipped, sections, lines, tips and q."""
    c = F.col
    status = F.concat(
        F.format_string("%d/%d pages matched.", c("n_kept"), c("n_tried")),
        F.when(c("n_skipped") > 0, F.format_string(" (%d already returned in this session)", c("n_skipped"))).otherwise(""),
    )
    nothing = F.when((F.size("sections") == 0) & (c("n_skipped") == 0), F.array(F.lit("\nNo relevant content extracted."))).otherwise(F.array().cast("array<string>"))
    parts = [F.array(status), c("sections"), nothing]
    if diagnostics:
        tips = F.when(F.size("tips") > 0, F.concat(F.array(F.lit("\n**Tips:**")), F.transform("tips", lambda t: F.concat(F.lit("- "), t)))).otherwise(F.array().cast("array<string>"))
        parts += [F.array(F.lit("\n---\n\n## Diagnostics"), F.concat(F.lit("Tokens: ["), F.array_join("q", ", "), F.lit("]\n"))), c("lines"), tips]
    return _join(F.concat(*parts))


def markdown(blocks: Column, budget: int) -> Column:
    """A page's blocks as Markdown until the budget ends; one paragraph may be cut."""
    size = text.utf16_length

    def step(acc: Column, b: Column) -> Column:
        level = F.when(b["type"].rlike(r"^h[1-6]\z"), F.substring(b["type"], 2, 1).cast("int"))
        left = budget - acc["used"]
        over = size(b["text"]) + 10 > left
        written = (
            F.when(level.isNotNull(), F.concat(F.when(acc["out"] != "", F.lit("\n")).otherwise(""), F.repeat(F.lit("#"), level), F.lit(" "), b["text"]))
            .when(b["type"] == "pre", F.concat(F.lit("```\n"), b["text"], F.lit("\n```")))
            .when(b["type"] == "li", F.concat(F.lit("- "), b["text"]))
            .otherwise(b["text"])
        )
        cost = size(b["text"]) + F.when(level.isNotNull(), level + 2).when(b["type"] == "pre", 8).when(b["type"] == "li", 2).otherwise(0)
        glue = F.when(acc["out"] == "", F.lit("")).otherwise(F.lit("\n"))
        cut = F.when((left > 100) & (b["type"] == "p"), F.concat(acc["out"], glue, F.substring(b["text"], F.lit(1), left - 3), F.lit("..."))).otherwise(acc["out"])
        out = F.when(acc["done"], acc["out"]).when(over, cut).otherwise(F.concat(acc["out"], glue, written))
        return F.struct(out.alias("out"), F.when(acc["done"] | over, acc["used"]).otherwise(acc["used"] + cost).cast("int").alias("used"), (acc["done"] | over).alias("done"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"))
    return F.aggregate(blocks, start, step, lambda acc: acc["out"])
