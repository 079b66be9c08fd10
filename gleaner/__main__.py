"""python -m gleaner: excerpts of a file, a URL, or a search.

  file PATH [--query Q]     excerpts of local HTML files (a glob is one job)
  url URL [--query Q]       excerpts of one page from the web, or its whole content
  search QUERY [--base-url] asks the search backend, fetches and extracts
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from .config import FETCH, FILE, Search
from .operators import render
from .plans import extract, fetch, search
from .session import local_session, materialize
from .sources import web
from .sources.pages import parsed_pages, read_whole
from .streaming import sessions


def show(explained) -> None:
    """A JSON line for each page that was ranked."""
    for row in explained.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gleaner", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("file", "path"), ("url", "url"), ("search", "query")):
        one = commands.add_parser(name)
        one.add_argument("what", metavar=what)
        if name != "search":
            one.add_argument("--query", default="")
        one.add_argument("--debug", action="store_true")
        if name == "search":
            one.add_argument("--session", default="", help="a folder that remembers for some seconds what was given")
        one.add_argument("--max-results", type=int, default=5)
        one.add_argument("--base-url", default=web.BASE_URL)
        one.add_argument("--timeout", type=float, default=web.TIMEOUT)
    a = parser.parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "file":
        asked = extract.query_table(spark, [(0, a.query)])
        parsed = materialize(parsed_pages(read_whole(spark, a.what)), "parsed")
        found, _ = extract.extract_parsed(parsed, asked, FILE)
        for row in render.excerpt_report(materialize(found, "found"), asked.select("query_id", "query")).toLocalIterator():
            print(row["report"])
        if a.debug:
            show(extract.explain(parsed, asked, FILE))
    elif a.command == "url":
        # with a query, a page is taken as it comes: without time limit, whatever its type
        get = web.get_any if a.query else web.get_page
        pages = web.fetch(spark.createDataFrame([(a.what,)], "url string"), a.timeout, get=get).withColumn("page_id", F.lit(0).cast("long"))
        pages = materialize(pages, "fetched")
        if a.debug and a.query:
            show(extract.explain(materialize(parsed_pages(pages.where("html is not null")), "parsed"), extract.query_table(spark, [(0, a.query)]), FETCH))
        print((fetch.fetch_for(pages, a.query) if a.query else fetch.fetch_pages(pages)).first()["content"])
    else:
        web.register(spark)
        asked = spark.createDataFrame([(0, a.what)], "query_id long, search_query string")
        c = Search(max_results=a.max_results)
        options = {"query": a.what, "base_url": a.base_url, "max_results": c.over_fetch * c.max_results, "timeout": a.timeout}
        hits = materialize(spark.read.format("websearch").options(**options).load().withColumn("query_id", F.lit(0).cast("long")), "hits")
        wanted = search.chosen_hits(hits, search.queries(asked), c).where("status = 'wanted'").select("url")
        pages = materialize(web.fetch(wanted.repartition(web.WORKERS), a.timeout).withColumn("page_id", F.xxhash64("url")), "fetched")
        seen = sessions.recall(spark, a.session, "cli", time.time(), asked, c.session_seconds) if a.session else None
        print(search.search(asked, hits, pages, c, seen, diagnostics=a.debug).first()["result"])
        if a.session:
            sessions.remember(search.search_tables(asked, hits, pages, c, seen)[2], a.session, "cli", time.time())


if __name__ == "__main__":
    main()
