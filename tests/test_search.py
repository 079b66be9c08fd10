"""Search, fetch, rendering and sessions, end to end on small tables."""

from __future__ import annotations

import random
import time

import pytest
from gleaner.config import DEFAULT, SEARCH, Search
from gleaner.operators import render, scoring
from gleaner.plans import extract, fetch, search
from gleaner.sources import web
from gleaner.streaming import sessions
from pyspark.sql import functions as F

FILLER = "This is a long enough sentence about ordinary matters that concern nobody in particular."


def article(title: str, *paragraphs: str) -> str:
    body = "".join(f"<h2>{p[3:]}</h2>" if p.startswith("## ") else f"<pre>{p[4:]}</pre>" if p.startswith("pre ") else f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>{title}</title></head><body><nav><p>menu entry</p></nav><main><h1>{title}</h1>{body}</main></body></html>"


HOOKS = article(
    "React hooks", "## State", "The useState hook lets a function component keep state between renders of the tree.", "Call the useState hook at the top of the component and never inside of loops.",
    "pre const [n, setN] = useState(0)", "## Effects", "The useEffect hook runs a cleanup function before the effect runs again.", *[FILLER] * 4,
)
OTHER = article("Gardening", *[f"{FILLER[:-1]}, number {i} in the list." for i in range(8)])
THIN = article("Thin hooks", "Short.", "Tiny.")
PAGES = [
    (1, "https://a.com/react/hooks", HOOKS, None),
    (2, "https://b.com/react-hooks", OTHER, None),
    (3, "https://c.com/hooks", None, "HTTP 403: Forbidden"),
    (4, "https://d.com/hooks", THIN, None),
    (5, "https://e.com/hooks", "<html><body></body></html>", None),
]
HITS = [(1, i, u, "React hooks state", "about useState", s, "x") for i, (u, s) in enumerate([
    ("https://b.com/react-hooks", 1.0), ("https://medium.com/react-hooks", 9.0), ("https://a.com/react/hooks", 5.0), ("https://docs.a.com/react/hooks", 8.0),
    ("https://c.com/hooks", 2.0), ("https://d.com/hooks", 3.0), ("https://e.com/hooks", 4.0),
])] + [(1, 7, "https://f.com/zzz", "nothing here", "at all", 7.0, "x")]


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, error string")
    hits = spark.createDataFrame(HITS, "query_id long, ordinal int, url string, title string, content string, score double, engine string")
    asked = spark.createDataFrame([(1, "site:x.com useState hook")], "query_id long, search_query string")
    return asked, hits, pages


def test_chosen_hits(tables):
    asked, hits, _ = tables
    rows = search.chosen_hits(hits, search.queries(asked), Search(max_results=10)).collect()
    got = {r["url"].split("/")[2]: (r["status"], r["place"]) for r in rows}
    assert got == {"medium.com": ("blocked_js", 1), "f.com": ("title_filtered", 1), "a.com": ("wanted", 1), "e.com": ("wanted", 2), "d.com": ("wanted", 3), "c.com": ("wanted", 4), "b.com": ("wanted", 5)}


def test_statuses(tables):
    kept, lines, keys = search.search_tables(*tables, Search(max_results=10))
    got = {r["url"].split("/")[2]: r["status"] for r in lines.collect()}
    assert got == {"medium.com": "blocked_js", "f.com": "title_filtered", "a.com": "success", "b.com": "not_relevant", "c.com": "scrape_failed", "d.com": "low_quality", "e.com": "no_content"}
    assert [r["page_id"] for r in kept.collect()] == [1]
    assert sorted(r["key"] for r in keys.collect())[0] == "https://a.com/react/hooks:hook,state,us"


def test_search_text(tables):
    got = search.search(*tables, Search(max_results=10), diagnostics=True).first()["result"]
    assert got.startswith("1/5 pages matched.\n\n---\n\n## [React hooks state](https://a.com/react/hooks)\n> React hooks")
    assert "```\nconst [n, setN] = useState(0)\n```" in got and "menu entry" not in got
    assert "Tokens: [us, state, hook]" in got
    assert "x [medium.com/react-hooks] SKIPPED: JS-rendered site" in got
    assert "- [c.com/hooks] FAILED: HTTP 403: Forbidden" in got and "x [d.com/hooks] SKIPPED: Too few sentences (1 < 5)" in got
    assert "- Only 1/6 pages had relevant content." in got


def test_session_skips(spark, tables):
    asked, hits, pages = tables
    seen = spark.createDataFrame([(1, "https://a.com/react/hooks:hook,state,us")], "query_id long, key string")
    got = search.search(asked, hits, pages, Search(max_results=10), seen, True).first()["result"]
    assert got.startswith("0/4 pages matched. (1 already returned in this session)") and "No relevant content" not in got
    assert "= [a.com/react/hooks] SKIPPED: Already fetched in this session" in got


def test_extraction_modes(spark, tables):
    pages = tables[2].where("html is not null")
    asked = extract.query_table(spark, [(1, "useState hook"), (2, "python django orm"), (3, "the of"), (4, "click")])
    parsed = extract.materialize(extract.parsed_pages(pages), "t")
    found, metrics = extract.extract_parsed(parsed, asked)
    rows = found.collect()
    assert {(r["query_id"], r["page_id"]) for r in rows} == {(1, 1), (3, 1), (3, 2)}
    first = [r for r in rows if r["query_id"] == 3 and r["page_id"] == 1]
    assert [r["text"] for r in sorted(first, key=lambda r: r["excerpt"])][0] == "React hooks" and first[0]["score"] <= 1
    m = {(r["query_id"], r["page_id"]): r for r in metrics.collect()}
    assert m[2, 1]["relevant"] is False and m[2, 1]["coverage"] == 0 and m[1, 4]["reject_reason"].startswith("Too few") and m[1, 5]["n_sentences"] is None
    skipped, _ = extract.extract_parsed(parsed, asked.where("query_id = 3"), DEFAULT.merged(skip_quality=True))
    assert {r["page_id"] for r in skipped.collect()} == {1, 2, 4}


def test_offsets_with_citations(spark):
    html = article("Hooks", "Retrieved 14 August 2025.", "Hello World.", *["The useState hook keeps state for the component that calls it."] * 2, *[FILLER] * 5)
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    asked = extract.query_table(spark, [(1, "useState hook")])
    plain = extract.extract(pages, asked, SEARCH).first()
    literal = extract.extract(pages, asked, SEARCH.merged(compat_offsets=True)).first()
    assert plain["anchor"] == 3 and plain["text"].startswith("Hooks\n\n") and "useState" in literal["text"]


def plain_budget(pages, total):
    out, used = {}, 0
    for page_id, sizes in pages:
        if used + sum(sizes) > total:
            left, n, got = total - used, 0, []
            if left > 200:
                for i, s in enumerate(sizes):
                    if n + s <= left:
                        n += s
                        got.append(i)
            out[page_id] = got
            break
        out[page_id] = list(range(len(sizes)))
        used += sum(sizes)
    return out


def test_page_budget_equals_plain(spark):
    pick = random.Random(1)
    rows, want = [], {}
    for query_id in range(60):
        pages = [(p, [pick.randint(50, 900) for _ in range(pick.randint(1, 5))]) for p in range(pick.randint(1, 9))]
        want |= {(query_id, p): got for p, got in plain_budget(pages, 3000).items() if got}
        rows += [(query_id, p, p, sum(s), [("x" * n, n) for n in s]) for p, s in pages]
    df = spark.createDataFrame(rows, "query_id int, page_id int, page_rank int, chars int, parts array<struct<text: string, char_count: int>>")
    kept = search.page_budget(df, 3000).where(F.size("kept") > 0).collect()
    assert {(r["query_id"], r["page_id"]): len(r["kept"]) for r in kept} == {k: len(v) for k, v in want.items()}


def test_fetch(spark, tables):
    pages = tables[2]
    got = {r["page_id"]: r["content"] for r in fetch.fetch_pages(pages).collect()}
    assert got[1].startswith("# React hooks\nSource: https://a.com/react/hooks\n\n# React hooks\n\n## State\nThe useState hook")
    assert "```\nconst [n, setN] = useState(0)\n```" in got[1] and got[3] == "Error fetching https://c.com/hooks: HTTP 403: Forbidden"
    assert got[5] == "# e.com\nSource: https://e.com/hooks\n\nCould not extract main content from page."
    cut = {r["page_id"]: r["content"] for r in fetch.fetch_pages(pages, 150).collect()}
    assert cut[1].endswith("renders of the tree.") and cut[2].endswith("number 0 in the list.")
    assert {r["page_id"]: r["content"] for r in fetch.fetch_pages(pages, 225).collect()}[2].endswith("...")
    asked = {r["page_id"]: r["content"] for r in fetch.fetch_for(pages, "useState hook").collect()}
    assert asked[1].startswith("# React hooks\nSource: https://a.com/react/hooks\n\n> React hooks > State\n") and asked[2].endswith('No relevant content found for query "useState hook".')


def test_status_lines(spark):
    rows = [(s, None, 2, 300, 0.25, 0.5) for s in [*render.STATUSES, "odd"]]
    df = spark.createDataFrame(rows, "status string, error string, excerpt_count int, char_count long, coverage double, max_bm25 double").withColumn("url", F.lit("https://www.a.com/x"))
    got = {r["status"]: r["line"] for r in df.withColumn("line", render.status_line()).collect()}
    assert got["success"] == "+ [a.com/x] 2 excerpt(s), 300 chars" and got["not_relevant"] == "- [a.com/x] SKIPPED: Not relevant (25% terms, score: 0.50)"
    assert got["title_filtered"] == "x [a.com/x] SKIPPED: Low title/snippet relevance (25% match)" and got["odd"] == "? [a.com/x] Unknown status"


def test_report(spark):
    found = spark.createDataFrame([(1, 1, 0, "T", ["A", "B"], 0.5, 10), (1, 1, 1, "U", [], 0.25, 5)], "query_id long, page_id long, excerpt int, text string, heading_path array<string>, score double, char_count int")
    asked = spark.createDataFrame([(1, "q w")], "query_id long, query string")
    assert render.excerpt_report(found, asked).first()["report"] == 'Query: "q w"\nTotal characters: 15\n\n--- Excerpt 1 (score: 0.500, 10 chars) ---\n[A > B]\nT\n\n--- Excerpt 2 (score: 0.250, 5 chars) ---\nU\n'


def test_web_rows_and_fetch(spark):
    rows = web.hit_rows({"results": [{"url": "u", "title": None, "score": 0}, {"url": "v", "content": "c", "engine": "e"}, {"url": "w"}]}, 2)
    assert rows == [(0, "u", "", "", 0.0, "unknown"), (1, "v", "", "c", 1.0, "e")]
    assert web.is_html("text/html; charset=utf-8") and not web.is_html("application/pdf")
    urls = spark.createDataFrame([("ok",), ("bad",)], "url string")
    got = web.fetch(urls, get=lambda u, t: ("<p>", None) if u == "ok" else (None, "Timeout after 5000ms")).collect()
    assert sorted(tuple(r) for r in got) == [("bad", None, "Timeout after 5000ms"), ("ok", "<p>", None)]
    assert web.get_page("http://127.0.0.1:9/", 1.0)[0] is None


ACCESSES = [("s", "2026-01-01 00:00:00", 0, "a"), ("s", "2026-01-01 00:00:05", 1, "a"), ("s", "2026-01-01 00:00:15", 2, "a"), ("s", "2026-01-01 00:00:26", 3, "a"), ("s", "2026-01-01 00:00:26", 4, "b"), ("t", "2026-01-01 00:00:05", 5, "a")]
SEEN = {0: False, 1: True, 2: True, 3: False, 4: False, 5: False}


def accesses(spark):
    return spark.createDataFrame(ACCESSES, "session_key string, ts string, seq long, key string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_batch_sessions(spark):
    assert {r["seq"]: r["seen"] for r in sessions.mark_seen(accesses(spark)).collect()} == SEEN


def run_stream(rows, name: str, folder, n: int, mode: str = "append"):
    """Rows of a stream that is stopped once there are ``n``: with processing-time
    timers it always runs another batch and would not end by itself."""
    stream = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "c")).start()
    try:
        for _ in range(120):
            found = rows.sparkSession.table(name).collect()
            if len(found) >= n or stream.exception():
                return found
            time.sleep(0.5)
        return found
    finally:
        stream.stop()


def test_streaming_sessions(spark, tmp_path):
    accesses(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("session_key string, ts timestamp, seq long, key string").parquet(str(tmp_path / "in"))
    assert {r["seq"]: r["seen"] for r in run_stream(sessions.stream_seen(rows), "seen", tmp_path, 6, "update")} == SEEN


def test_streaming_pages_and_event_time(spark, tmp_path):
    spark.createDataFrame([p[:3] for p in PAGES if p[2]], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    assert len(run_stream(sessions.stream_pages(spark, str(tmp_path / "p")), "parsed", tmp_path, 4)) == 4
    spans = sessions.event_sessions(accesses(spark)).collect()
    assert sorted((r["session_key"], r["n_accesses"]) for r in spans) == [("s", 2), ("s", 3), ("t", 1)]


def test_many_queries_need_no_pairs(spark, tables):
    """More queries than pages could be crossed with in texts: only matching pairs are scored."""
    parsed = extract.materialize(extract.parsed_pages(tables[2].where("html is not null")), "t")
    asked = extract.query_table(spark, [(i, "useState hook" if i % 4000 == 0 else f"nothing{i} here{i}") for i in range(12_000)])
    assert sorted({(r["query_id"], r["page_id"]) for r in extract.extract_parsed(parsed, asked)[0].collect()}) == [(0, 1), (4000, 1), (8000, 1)]
    postings = extract._postings(extract.page_sentences(parsed, DEFAULT), asked, None)
    assert {r["query_id"] % 4000 for r in postings.select("query_id").distinct().collect()} == {0}


def test_weights_and_token_options_reach_extraction(spark, tables):
    pages = tables[2].where("html is not null")
    asked = extract.query_table(spark, [(1, "useState hook")])
    usual, other = (extract.extract(pages, asked, DEFAULT.merged(ranker=r)).collect() for r in ({}, {"weights": {"position": 5.0}}))
    assert usual and [r["score"] for r in usual] != [r["score"] for r in other]
    with pytest.raises(ValueError):
        extract.extract(pages, asked, DEFAULT.merged(ranker={"weights": {"colour": 1.0}})).collect()
    c = DEFAULT.merged(tokens={"stop_words": False, "min_length": 1})
    parsed = extract.materialize(extract.parsed_pages(pages), "t")
    held = {t for r in extract.page_sentences(parsed, c).select("tokens").collect() for t in r["tokens"]}
    usual = {t for r in extract.page_sentences(parsed, DEFAULT).select("tokens").collect() for t in r["tokens"]}
    assert "the" in held and "the" not in usual
    assert extract.query_table(spark, [(1, "the x hook")], tokens=c.tokens).first()["q"] == ["the", "x", "hook"]


def test_matches_equal_relevance(spark, tables):
    """The narrow form gives what the scores of whole rows give."""
    parsed = extract.materialize(extract.parsed_pages(tables[2].where("html is not null")), "t")
    sentences = extract.page_sentences(parsed, DEFAULT)
    asked = extract.query_table(spark, [(1, "useState hook"), (2, "hook hook component"), (3, "state keeps click")])
    rows = sentences.crossJoin(asked)
    want = scoring.relevance(rows, scoring.page_stats(rows)).where("cooccurrence > 0")
    stats = sentences.groupBy("page_id").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    got = scoring.matches(extract._postings(sentences, asked, None), stats)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 2


def test_explained_pages(spark, tables):
    parsed = extract.materialize(extract.parsed_pages(tables[2].where("html is not null")), "t")
    rows = {(r["query_id"], r["page_id"]): r for r in extract.explain(parsed, extract.query_table(spark, [(1, "useState hook"), (2, "python django orm")])).collect()}
    good, bad = rows[1, 1], rows[2, 1]
    assert good["relevant"] and good["n_anchors"] == good["n_chunks"] >= good["n_deduped"] >= 1 and 5 < len(good["top"]) <= 10
    assert not bad["relevant"] and (bad["n_anchors"], len(bad["top"])) == (0, 5)
    scores = [t["score"] for t in good["top"]]
    assert scores == sorted(scores, reverse=True) and all(len(t["text"]) <= 103 for t in good["top"])


def test_session_log_feeds_the_next_search(spark, tables, tmp_path):
    asked, hits, pages = tables
    log, c = f"{tmp_path}/log", Search(max_results=10)
    assert sessions.recall(spark, log, "s", 100.0, asked).count() == 0
    first = search.search_tables(asked, hits, pages, c)[2]
    sessions.remember(first, log, "s", 100.0)
    seen = sessions.recall(spark, log, "s", 105.0, asked)
    assert {r["key"] for r in seen.collect()} == {r["key"] for r in first.collect()} and seen.count() >= 3
    assert search.search(asked, hits, pages, c, seen, True).first()["result"].startswith("0/")
    assert sessions.recall(spark, log, "other", 105.0, asked).count() == 0
    assert sessions.recall(spark, log, "s", 111.0, asked).count() == 0  # it has rested
    sessions.remember(spark.createDataFrame([(1, "k")], "query_id long, key string"), log, "s", 120.0)
    assert {r["key"] for r in sessions.recall(spark, log, "s", 125.0, asked).collect()} == {"k"}


def test_pages_without_gate_or_time_limit(monkeypatch):
    asked = []
    monkeypatch.setattr(web, "get_page", lambda url, timeout, gate=True: asked.append((timeout, gate)) or ("x", None))
    assert web.get_any("http://x") == ("x", None) and asked == [(None, False)]
