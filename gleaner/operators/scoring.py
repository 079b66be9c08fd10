"""Sentence scoring: BM25, nine heuristics, relevance and rank.

All statistics belong to one (query, page) group: a sentence is the document and
a page the corpus. Rows of one group share one hash partitioning, so the page
statistics, every window and the rank below need a single shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Bm25, Ranker
from ..functions import text
from .segment import is_heading

KEYS = ("query_id", "page_id")

# Weights, headings of sections about the page itself, and phrases of that kind.
WEIGHTS = {
    "position": 0.05, "heading_proximity": 0.11, "density": 0.09, "structure": 0.11, "proximity": 0.14,
    "heading_path": 0.17, "coverage": 0.16, "outlier": 0.09, "meta_section": 0.08,
}
META_HEADINGS = [
    r"^introduction\z", r"^overview\z", r"^about(\s+this)?(\s+(article|guide|tutorial|post|page))?\z", r"^what('s|\s+is)\s+this",
    r"^what\s+you('ll|.will)\s+(learn|cover|build|create)", r"^what\s+we('ll|.will)\s+(learn|cover|build|create)", r"^in\s+this\s+(article|guide|tutorial|post)",
    r"^getting\s+started\z", r"^before\s+(you\s+)?begin", r"^prerequisites?\z", r"^requirements?\z", r"^background\z", r"^context\z",
    r"^summary\z", r"^conclusion\z", r"^tl;?\s*dr\z", r"^takeaways?\z", r"^key\s+takeaways?\z", r"^key\s+points?\z", r"^wrapping\s+up\z",
    r"^final\s+thoughts?\z", r"^closing\s+thoughts?\z", r"^in\s+summary\z", r"^to\s+summarize\z", r"^recap\z",
    r"^next\s+steps?\z", r"^what('s|.is)\s+next", r"^further\s+reading\z", r"^additional\s+resources?\z", r"^related\s+(articles?|posts?|content|links?|resources?)",
    r"^see\s+also\z", r"^learn\s+more\z", r"^more\s+resources?\z", r"^references?\z", r"^sources?\z", r"^bibliography\z", r"^credits?\z", r"^acknowledgements?\z",
    r"^about\s+(the\s+)?author", r"^author(\s+bio)?\z", r"^bio(graphy)?\z", r"^written\s+by\z", r"^posted\s+by\z", r"^published\s+by\z",
    r"^comments?\z", r"^feedback\z", r"^discussion\z", r"^share(\s+this)?\z", r"^subscribe\z", r"^newsletter\z", r"^follow(\s+us)?\z",
    r"^connect(\s+with\s+us)?\z", r"^join(\s+us)?\z", r"^support(\s+us)?\z", r"^donate\z", r"^buy\s+me\s+a\s+coffee", r"^sponsor",
    r"^table\s+of\s+contents?\z", r"^contents?\z", r"^toc\z", r"^navigation\z", r"^menu\z", r"^sidebar\z", r"^footer\z", r"^header\z", r"^breadcrumb", r"^skip\s+to",
    r"^more\s+info(rmation)?\z", r"^external\s+links?\z", r"^useful\s+links?\z", r"^quick\s+links?\z", r"^related\s+topics?\z", r"^related\s+guides?\z",
    r"^related\s+tutorials?\z", r"^related\s+documentation\z", r"^other\s+resources?\z", r"^specifications?\z", r"^browser\s+compatibility\z", r"^browser\s+support\z",
    r"^disclaimer\z", r"^disclosure\z", r"^affiliate\s+disclosure", r"^privacy(\s+policy)?\z", r"^terms(\s+(of\s+)?(use|service))?\z", r"^copyright\z", r"^legal\z",
    r"^featured\z", r"^trending\z", r"^popular(\s+posts?)?\z", r"^recommended\z", r"^you\s+might\s+(also\s+)?like\z", r"^related\s+posts?\z", r"^top\s+stories\z",
    r"^latest(\s+posts?)?\z", r"^recent(\s+posts?)?\z", r"^archives?\z", r"^categories\z", r"^tags?\z",
]
META_PHRASES = [
    "in this article", "in this guide", "in this tutorial", "in this post", "we will cover", "we'll cover", "you will learn", "you'll learn",
    "we will explore", "we'll explore", "let's explore", "let's dive", "let's get started", "i will show you", "i'll show you", "we will discuss",
    "we'll discuss", "this article covers", "this guide covers", "this tutorial covers", "by the end of this", "after reading this", "if you enjoyed this",
    "if you found this helpful", "don't forget to", "make sure to subscribe", "leave a comment", "share this article", "follow me on", "check out my",
    "support my work", "buy me a coffee",
]


def group(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def page_stats(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, avgdl and df (sentences that hold it, for each query token in order)."""
    held = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.size("tokens")).alias("avgdl"),
        F.any_value("q").alias("q"),
        F.flatten(F.collect_list(F.array_intersect(F.col("q"), F.col("tokens")))).alias("held"),
    )
    return held.select(*keys, "n", "avgdl", F.transform("q", lambda t: F.size(F.filter("held", lambda x: x == t))).alias("df"))


def bm25(c: Bm25 = Bm25()) -> Column:
    """Summed over query tokens in order, repeats included."""
    size = F.size("tokens")
    norm = c.k1 * (1 - c.b + c.b * _ratio(size.cast("double"), F.col("avgdl")))

    def gain(pair: Column) -> Column:
        tf = F.size(F.filter("tokens", lambda x: x == pair["t"]))
        return F.when(tf == 0, F.lit(0.0)).otherwise(idf(F.col("n"), pair["df"]) * (tf * (c.k1 + 1)) / (tf + norm))

    pairs = F.zip_with("q", "df", lambda t, df: F.struct(t.alias("t"), df.alias("df")))
    return F.aggregate(pairs, F.lit(0.0), lambda total, p: total + gain(p))


def idf_overlap(words: Column) -> Column:
    """Share of the query's idf that ``words`` cover, repeats included."""
    pairs = F.zip_with("q", "df", lambda t, df: F.struct(t.alias("t"), idf(F.col("n"), df).alias("w")))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"])
    return _ratio(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(F.array_contains(words, p["t"]), p["w"]).otherwise(F.lit(0.0))), total)


def position_score(p: Column) -> Column:
    return F.when(p <= 0.3, 1 - p / 0.3 * 0.3).when(p <= 0.7, 0.7 - (p - 0.3) / 0.4 * 0.2).otherwise(0.5 - (p - 0.7) / 0.3 * 0.2)


def raw_density() -> Column:
    return _ratio(text.found_in(F.col("tokens"), F.col("q")).cast("double"), F.size("tokens"))


def matched() -> Column:
    """Distinct query tokens in the sentence."""
    return F.array_intersect(F.col("q"), F.col("tokens"))


def density_score() -> Column:
    return F.when(F.size("tokens") == 0, F.lit(0.0)).otherwise(raw_density() * 0.4 + _ratio(F.size(matched()).cast("double"), F.size("q")) * 0.6)


def shortest_span() -> Column:
    """Length of the shortest stretch of tokens with every matched term; for each
    start, the farthest of the terms' next occurrences."""
    n = F.size("tokens")
    places = F.filter(F.transform("tokens", lambda t, i: F.when(F.array_contains(F.col("q"), t), i + 1)), lambda i: i.isNotNull())

    def reach(start: Column) -> Column:
        following = F.transform(matched(), lambda t: F.array_position(F.slice("tokens", start, n), t))
        return F.when(F.exists(following, lambda x: x == 0), F.lit(None)).otherwise(F.array_max(following))

    return F.array_min(F.transform(places, reach))


def proximity_score() -> Column:
    found = F.size(matched())
    cover = _ratio(found.cast("double"), F.size("q"))
    span = shortest_span()
    several = cover * 0.4 + (1 - F.least(F.lit(1.0), span / F.size("tokens"))) * 0.35 + F.least(F.lit(1.0), found / span) * 0.25
    return F.when(found == 0, F.lit(0.0)).when(found == 1, cover * 0.5).otherwise(several)


def heading_proximity_score(w: WindowSpec) -> Column:
    head = F.last(F.when(is_heading(F.col("block_type")), F.struct(F.col("at"), F.col("tokens"))), ignorenulls=True).over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    near = 1 / (1 + (F.col("at") - head["at"]) / 5)
    share = text.overlap(F.col("q"), head["tokens"])
    return F.when(head.isNull(), F.lit(0.3)).when(share > 0, F.least(F.lit(1.0), share * 0.6 + near * 0.4)).otherwise(near * 0.5)


def structure_score(keys: tuple[str, ...], sql: bool = False) -> Column:
    """Added in hundredths: 0.8 + 0.15 as doubles is more than 0.95."""
    kind = F.col("block_type")
    base = F.when(kind == "p", 80).when(kind == "li", 70).when(kind == "pre", 65).otherwise(40)
    code_near = F.max((kind == "pre").cast("int")).over(group(keys).orderBy("global_index").rangeBetween(-2, 2)) == 1
    hit = (text.overlap(F.col("q"), F.col("tokens")) > 0.3).cast("int")
    others = F.sum(hit).over(Window.partitionBy(*keys, "block_index")) - hit > 0
    above = F.exists("heading_path", lambda h: F.exists("q", lambda t: F.contains(text.lower(h, sql), t)))
    bonus = F.when(others, 15).otherwise(0) + F.when(above, 10).otherwise(0) + F.when((kind != "pre") & code_near, 10).otherwise(0)
    return F.least(F.lit(100), base + bonus) / 100.0


def heading_path_score() -> Column:
    return F.when((F.size("heading_path") == 0) | (F.size("path_tokens") == 0), F.lit(0.3)).otherwise(0.3 + idf_overlap(F.col("path_tokens")) * 0.7)


def coverage_score() -> Column:
    simple = text.overlap(F.col("q"), F.col("tokens"))
    return F.when(F.size("tokens") == 0, F.lit(0.0)).otherwise(idf_overlap(F.col("tokens")) * 0.7 + simple * 0.3)


def outlier_score() -> Column:
    z = (F.col("raw_density") - F.col("density_median")) / F.col("density_mad")
    return F.when((F.size("tokens") == 0) | (z <= 0), F.lit(0.3)).otherwise(0.3 + 0.7 / (1 + F.exp(-(z - 2))))


def meta_section_score(sql: bool = False) -> Column:
    heading = "(?i)" + "|".join(f"(?:{p.replace(chr(92) + 's', text.SQL_SPACE) if sql else p})" for p in META_HEADINGS)
    low = text.lower(F.col("text"), sql)
    phrase = reduce(lambda a, p: a | F.contains(low, F.lit(p)), META_PHRASES, F.lit(False))
    return F.when(F.exists("heading_path", lambda h: text.trim(h, sql).rlike(heading)), F.lit(0.2)).when(phrase, F.lit(0.3)).otherwise(F.lit(1.0))


def normalized(c: Column, w: WindowSpec) -> Column:
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.coalesce((c - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.5))


def relevant(mode: str, best: Column, cover: Column, together: Column, central: Column) -> Column:
    if mode == "search":
        return (best > 0.8) & (cover >= 0.25) | (together >= 2) & (best > 0.5) | central & (best > 0.4) | (cover >= 0.5) & (best > 0.3)
    return (together >= 2) & (best > 1.0) | central & (best > 0.8) | (cover >= 0.8) & (best > 0.5)


def matches(postings: DataFrame, stats: DataFrame, c: Bm25 = Bm25(), mode: str = "strict", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``relevance`` from postings (keys, at, nth, n_terms, term, tf, size): a narrow row
    for each token of a query, by its place ``nth``, and sentence ``at`` that holds it.
    ``stats`` has n and avgdl by page. Groups without a match have no row."""
    page, c_ = [k for k in keys if k != "query_id"], F.col
    df = F.count("*").over(Window.partitionBy(*keys, "nth"))
    rows = postings.join(stats, page).withColumn("df", df)
    norm = c.k1 * (1 - c.b + c.b * _ratio(c_("size").cast("double"), c_("avgdl")))
    gain = idf(c_("n"), c_("df")) * (c_("tf") * (c.k1 + 1)) / (c_("tf") + norm)
    # summed in the order of the query's tokens, as bm25() does
    held = rows.groupBy(*keys, "at").agg(
        F.array_sort(F.collect_list(F.struct("nth", gain.alias("gain")))).alias("gains"), F.count_distinct("term").alias("together"),
        F.max("df").alias("df"), F.any_value("n").alias("n"), F.any_value("n_terms").alias("n_terms"), F.collect_set("term").alias("terms"),
    )
    best = F.max(F.aggregate("gains", F.lit(0.0), lambda total, g: total + g["gain"]))
    found = held.groupBy(*keys).agg(
        F.any_value("n").alias("n"), F.greatest(F.lit(0.0), best).alias("max_bm25"), F.max("together").cast("int").alias("cooccurrence"), F.max("df").alias("df"),
        F.any_value("n_terms").alias("n_terms"), F.size(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("n_found"),
    )
    return (
        found.withColumn("coverage", c_("n_found").cast("double") / c_("n_terms"))
        .withColumn("has_central", c_("df") >= F.greatest(F.lit(3.0), c_("n") * 0.1))
        .withColumn("relevant", relevant(mode, c_("max_bm25"), c_("coverage"), c_("cooccurrence"), c_("has_central")))
        .select(*keys, "n", "max_bm25", "coverage", "cooccurrence", "has_central", "relevant")
    )


def relevance(rows: DataFrame, stats: DataFrame, mode: str = "strict", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row a group: n, max_bm25, coverage, cooccurrence, has_central, relevant."""
    joined = rows if "raw_bm25" in rows.columns else rows.join(stats, list(keys)).withColumn("raw_bm25", bm25())
    page = joined.groupBy(*keys).agg(
        F.any_value("n").alias("n"),
        F.greatest(F.lit(0.0), F.max("raw_bm25")).alias("max_bm25"),
        F.max(F.size(matched())).alias("cooccurrence"),
        F.any_value("df").alias("df"),
        F.any_value("q").alias("q"),
    )
    found = F.size(F.array_distinct(F.filter("q", lambda t, i: F.get("df", i) > 0)))
    c = F.col
    return (
        page.withColumn("coverage", _ratio(found.cast("double"), F.size("q")))
        .withColumn("has_central", F.exists("df", lambda d: d >= F.greatest(F.lit(3.0), c("n") * 0.1)))
        .withColumn("relevant", relevant(mode, c("max_bm25"), c("coverage"), c("cooccurrence"), c("has_central")))
        .select(*keys, "n", "max_bm25", "coverage", "cooccurrence", "has_central", "relevant")
    )


def heuristics(rows: DataFrame, keys: tuple[str, ...] = KEYS, weights: dict[str, float] | None = None, sql: bool = False) -> DataFrame:
    """Adds the nine scores (h_*) and their weighted sum to rows that hold q, the
    page statistics, ``at`` (the sentence's place) and path_tokens."""
    if unknown := set(weights or ()) - set(WEIGHTS):
        raise ValueError(f"no such heuristics: {sorted(unknown)}")
    w = group(keys)
    near = rows.withColumn("raw_density", raw_density()).withColumn("density_median", F.median("raw_density").over(w))
    near = near.withColumn("density_mad", F.greatest(F.lit(0.001), F.median(F.abs(F.col("raw_density") - F.col("density_median"))).over(w)))
    scored = near.withColumns({
        "h_position": position_score(F.col("position")),
        "h_heading_proximity": heading_proximity_score(w),
        "h_density": density_score(),
        "h_structure": structure_score(keys, sql),
        "h_proximity": proximity_score(),
        "h_heading_path": heading_path_score(),
        "h_coverage": coverage_score(),
        "h_outlier": outlier_score(),
        "h_meta_section": meta_section_score(sql),
    })
    return scored.withColumn("heuristic_score", sum((F.col(f"h_{k}") * v for k, v in (WEIGHTS | (weights or {})).items()), F.lit(0.0)))


def ranked(rows: DataFrame, keys: tuple[str, ...] = KEYS, ranker: Ranker = Ranker(), c: Bm25 = Bm25(), sql: bool = False) -> DataFrame:
    """All scores of every sentence and its rank in the group."""
    joined = rows.join(page_stats(rows, keys), list(keys)).withColumn("raw_bm25", bm25(c))
    w = group(keys)
    scored = heuristics(joined, keys, ranker.weights, sql).withColumn("bm25_score", normalized(F.col("raw_bm25"), w))
    scored = scored.withColumn("combined_score", ranker.bm25_weight * F.col("bm25_score") + ranker.heuristic_weight * F.col("heuristic_score"))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.col("combined_score").desc(), "global_index")))
