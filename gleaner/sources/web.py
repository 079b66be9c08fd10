"""Search backend and web pages: a Python data source and a bounded fetch.

Both turn failures into rows or clear errors; nothing else here needs a network.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

HITS = "ordinal int, url string, title string, content string, score double, engine string"
BASE_URL = "http://localhost:8080"
WORKERS, TIMEOUT = 3, 5.0
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; gleaner)", "Accept": "text/html,application/xhtml+xml", "Accept-Language": "en-US,en;q=0.9"}


def hit_rows(payload: dict, most: int) -> list[tuple]:
    """The first results of a backend's JSON, with defaults for what is missing."""
    return [
        (i, r["url"], r.get("title") or "", r.get("content") or "", float(1 if r.get("score") is None else r["score"]), r.get("engine") or "unknown")
        for i, r in enumerate((payload.get("results") or [])[:most])
    ]


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        url = f"{o.get('base_url', BASE_URL).rstrip('/')}/search?" + urllib.parse.urlencode({"q": o["query"], "format": "json"})
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=float(o.get("timeout", TIMEOUT))) as answer:
            yield from hit_rows(json.load(answer), int(o.get("max_results", 10)))


class SearchSource(DataSource):
    """spark.read.format("websearch").option("query", ...): hits in backend order."""

    @classmethod
    def name(cls) -> str:
        return "websearch"

    def schema(self) -> str:
        return HITS

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SearchSource)


def is_html(content_type: str) -> bool:
    return "text/html" in content_type or "application/xhtml" in content_type


def get_page(url: str, timeout: float | None = TIMEOUT, gate: bool = True) -> tuple[str | None, str | None]:
    """(html, error): one of both is null."""
    late = "Timeout" if timeout is None else f"Timeout after {timeout * 1000:.0f}ms"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as answer:
            kind = answer.headers.get("Content-Type", "")
            if gate and not is_html(kind):
                return None, f"Non-HTML content type: {kind}"
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return None, f"HTTP {e.code}: {e.reason}"
    except TimeoutError:
        return None, late
    except urllib.error.URLError as e:
        return None, late if isinstance(e.reason, TimeoutError) else str(e.reason)
    except Exception as e:
        return None, str(e) or "Unknown error"


def get_any(url: str, timeout: float | None = None) -> tuple[str | None, str | None]:
    """A page whatever its type, without time limit."""
    return get_page(url, None, gate=False)


def fetch(urls: DataFrame, timeout: float = TIMEOUT, workers: int = WORKERS, get: Callable[[str, float], tuple] = get_page) -> DataFrame:
    """url, html, error of each row of ``urls``: a few requests at a time in each
    task, failures as rows. More partitions fetch more at a time."""
    ship(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as threads:
            for batch in batches:
                names = batch.column("url").to_pylist()
                for at in range(0, len(names), 100):
                    part = names[at : at + 100]
                    got = list(threads.map(lambda u: get(u, timeout), part))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([h for h, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["url", "html", "error"])

    return urls.select("url").mapInArrow(run, "url string, html string, error string")
