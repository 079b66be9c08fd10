"""Extraction: many queries over many pages in one job.

Pages are parsed once, whatever the number of queries, and html goes no further
than the parser. Queries meet pages through an inverted table of narrow rows (term,
page, sentence): a page without a query's terms costs that query nothing, and texts
are joined only to the pairs of query and page that pass the quality and relevance
gates, before the windows of the scores and the sequential steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Extraction, Tokens
from ..functions import text
from ..functions.stem import stemmed
from ..operators import excerpts as ex
from ..operators import quality, scoring, segment
from ..session import materialize
from ..sources.pages import parsed_pages

KEYS = ("query_id", "page_id")


def query_table(spark: SparkSession, queries: list[tuple[int, str]], stem: bool = True, tokens: Tokens = DEFAULT.tokens) -> DataFrame:
    """query_id, query, q (tokens) of a list the caller holds."""
    rows = spark.createDataFrame(queries, "query_id long, query string")
    words = text.tokens(F.col("query"), tokens.stop_words, tokens.min_length)
    return rows.withColumn("q", stemmed(words) if stem else words)


def page_sentences(parsed: DataFrame, c: Extraction) -> DataFrame:
    """Sentences without citations, with tokens of their heading path."""
    rows = quality.without_citations(segment.sentences(parsed, c.stem, tokens=c.tokens, sql=c.sql), sql=c.sql).withColumn("at", F.col("global_index") if c.compat_offsets else F.col("pos"))
    path = text.tokens(F.array_join("heading_path", " "), c.tokens.stop_words, c.tokens.min_length, c.sql)
    return rows.withColumn("path_tokens", stemmed(path) if c.stem else path)


def _postings(sentences: DataFrame, queries: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """query_id, page_id, at, nth, n_terms, term, tf, size: where query tokens stand."""
    size = F.size("tokens")
    term = F.explode(F.array_distinct("tokens")).alias("term")
    held = sentences.select("page_id", F.col("global_index").alias("at"), size.alias("size"), "tokens", term)
    held = held.select("page_id", "at", "size", "term", F.size(F.filter("tokens", lambda t: t == F.col("term"))).alias("tf"))
    asked = queries.select("query_id", F.size("q").alias("n_terms"), F.posexplode("q").alias("nth", "term"))
    if pairs is None:
        return held.join(asked, "term")
    return held.join(pairs.join(asked, "query_id"), ["page_id", "term"])


def extract_parsed(parsed: DataFrame, queries: DataFrame, c: Extraction = DEFAULT, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(excerpts, metrics) of each query and page, or of ``pairs`` (query_id, page_id).

    metrics has a row for each pair, all pairs if none are given (narrow rows, made
    only if they are read): n_sentences, max_bm25, coverage, cooccurrence and relevant
    are null where extraction ended before they are known.
    """
    sentences = materialize(page_sentences(parsed, c), "sentences")
    gate = quality.page_quality(sentences, c.quality)
    gate = materialize(gate.withColumn("passes", F.lit(True)) if c.skip_quality else gate, "gate")
    wanted = None if pairs is None else pairs.select(*KEYS).distinct()
    passing = sentences.join(gate.where("passes").select("page_id"), "page_id", "left_semi")
    stats = passing.groupBy("page_id").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    found = materialize(scoring.matches(_postings(passing, queries, wanted), stats, c.bm25, c.ranker.mode), "matches")
    good = found.where("relevant").select(*KEYS).join(queries.select("query_id", "q"), "query_id").join(sentences, "page_id")
    ranked = scoring.ranked(good, KEYS, c.ranker, c.bm25)
    every = parsed.select("page_id").crossJoin(queries.select("query_id", "q")) if wanted is None else wanted.join(queries.select("query_id", "q"), "query_id")
    # a query without tokens gets the openings of pages: all rows of its result hold texts
    opening = every.where(F.size("q") == 0).join(passing, "page_id")
    judged = F.col("passes") & (F.size("q") > 0)
    unmatched = F.when(judged, F.lit(0.0))
    metrics = every.join(gate, "page_id", "left").join(found, list(KEYS), "left").select(
        *KEYS, F.when(F.size("q") > 0, F.col("n_sentences")).alias("n_sentences"), F.coalesce("max_bm25", unmatched).alias("max_bm25"), F.coalesce("coverage", unmatched).alias("coverage"),
        F.coalesce("cooccurrence", unmatched.cast("int")).alias("cooccurrence"), F.coalesce("relevant", F.when(judged, F.lit(False))).alias("relevant"), F.when(~F.col("passes"), F.col("reject_reason")).alias("reject_reason"),
    )
    return ex.excerpts(ranked, c, KEYS).unionByName(ex.opening(opening, c, KEYS)), metrics


DEBUG = "n_anchors int, n_chunks int, n_deduped int, texts array<string>, scores array<double>, paths array<string>"


def explain(parsed: DataFrame, queries: DataFrame, c: Extraction = DEFAULT, pairs: DataFrame | None = None) -> DataFrame:
    """``metrics`` of pairs that were ranked, with the counts of each step and the best
    sentences: ten of relevant pages, five of others. Every pair of ``pairs`` (all, if
    none are given) is ranked for it: for looking into some pages, not for whole corpora."""
    _, metrics = extract_parsed(parsed, queries, c, pairs)
    judged = materialize(metrics.where("relevant is not null"), "judged")
    rows = judged.select(*KEYS, "relevant").join(queries.select("query_id", "q"), "query_id").join(page_sentences(parsed, c), "page_id")
    ranked = scoring.ranked(rows, KEYS, c.ranker, c.bm25).select(*KEYS, "relevant", "global_index", "text", "tokens", "block_type", "heading_path", "combined_score")

    def make(held: list[dict]) -> list[tuple]:
        sentences = ex._sentences(held)
        page, best = ex.Page(sentences), sorted(sentences, key=lambda s: (-s.score, s.index))
        best_few = best[: 10 if held[0]["relevant"] else 5]
        top = [s.text[:100] + "..." * (len(s.text) > 100) for s in best_few], [s.score for s in best_few], [" > ".join(s.path) for s in best_few]
        if not held[0]["relevant"]:
            return [(0, 0, 0, *top)]
        anchors = ex.choose_anchors(best, c.anchors)
        chunks = [page.chunk(a, c.expand, a.pos) for a in anchors]
        return [(len(anchors), len(chunks), len(ex.drop_contained(ex.merge_chunks(page, chunks, c.dedupe))), *top)]

    steps = ex.streamed(ranked, list(KEYS), ["global_index"], make, DEBUG)
    top = F.arrays_zip(F.col("texts").alias("text"), F.col("scores").alias("score"), F.col("paths").alias("heading_path"))
    return judged.join(steps.withColumn("top", top).drop("texts", "scores", "paths"), list(KEYS))


def extract(pages: DataFrame, queries: DataFrame, c: Extraction = DEFAULT, pairs: DataFrame | None = None) -> DataFrame:
    """Excerpts of pages (page_id, url, html) for queries (query_id, query, q)."""
    return extract_parsed(materialize(parsed_pages(pages), "parsed"), queries, c, pairs)[0]
