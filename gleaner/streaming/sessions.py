"""Session memory: what a session has already been given, for a sliding time.

Batch: over a table of accesses, in order. Streaming: state per session key with
a timer that each access renews; what was given is skipped until the session has
rested for longer than the time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..sources.pages import parsed_pages

SECONDS = 10


def mark_seen(accesses: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Adds ``session`` (numbered by its rests) and ``seen``: whether the session
    was given this key before. accesses: session_key, ts, seq (breaks ties), key.

    One session's accesses share a task, as they do in the stream; sessions are
    many, and a row is an access, not a page."""
    order = Window.partitionBy("session_key").orderBy("ts", "seq")
    at = F.col("ts").cast("timestamp").cast("double")
    rest = at - F.lag(at).over(order)
    begun = accesses.withColumn("session", F.sum(F.coalesce((rest > seconds).cast("int"), F.lit(0))).over(order))
    nth = F.row_number().over(Window.partitionBy("session_key", "session", "key").orderBy("ts", "seq"))
    return begun.withColumn("seen", nth > 1)


def remember(keys: DataFrame, path: str, session_key: str, now: float) -> None:
    """Appends ``keys`` (query_id, key; ``search_tables`` gives them, of failed pages too)
    to the session's log at ``path``, as given at ``now`` (seconds). Concurrent appends
    are safe; a failed one leaves nothing."""
    rows = keys.select(F.lit(session_key).alias("session_key"), "key", F.timestamp_seconds(F.lit(now)).alias("ts"))
    rows.write.mode("append").partitionBy("session_key").parquet(path)


def recall(spark: SparkSession, path: str, session_key: str, now: float, queries: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """query_id, key: what the session was given since it last rested, for each of
    ``queries``; nothing if it rests at ``now``, or has no log."""
    empty = queries.limit(0).select("query_id", F.lit("").alias("key"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return empty
    log = spark.read.schema("session_key string, key string, ts timestamp").parquet(path).where(F.col("session_key") == session_key)
    at = F.col("ts").cast("double")
    # an access a search, not a key: the rests are found among few rows
    accesses = log.select("ts").distinct().withColumn("rest", F.lead(at, 1, now).over(Window.orderBy("ts")) - at > seconds)
    rested = accesses.where("rest").agg(F.max("ts").alias("rested"))
    current = log.join(rested).where(F.col("rested").isNull() | (F.col("ts") > F.col("rested"))).select("key").distinct()
    return queries.select("query_id").distinct().join(current).select("query_id", "key")


class SessionMemory(StatefulProcessor):
    """transformWithState processor: keys given, and when the session was last used."""

    def __init__(self, seconds: float = SECONDS):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getMapState("given", "key string", "at timestamp")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        out = []
        last = self.last.get()[0] if self.last.exists() else None
        for row in table.itertuples():
            now = int(row.ts.timestamp() * 1000)
            if last is not None and now - last > self.seconds * 1000:
                self.given.clear()
            last = now
            seen = self.given.containsKey((row.key,))
            if not seen:
                self.given.updateValue((row.key,), (row.ts.to_pydatetime(),))
            out.append((key[0], row.key, row.ts, row.seq, bool(seen)))
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000) + 1)
        yield pd.DataFrame(out, columns=["session_key", "key", "ts", "seq", "seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.given.clear()
        self.last.clear()
        yield pd.DataFrame({"session_key": [], "key": [], "ts": pd.to_datetime([]), "seq": [], "seen": []}).astype({"session_key": str, "key": str, "seq": "int64", "seen": bool})

    def close(self) -> None:
        pass


def stream_seen(accesses: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """The streaming form of ``mark_seen``; needs the RocksDB state store."""
    spark = accesses.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return accesses.groupBy("session_key").transformWithStateInPandas(
        SessionMemory(seconds), "session_key string, key string, ts timestamp, seq long, seen boolean", "Update", "ProcessingTime"
    )


def event_sessions(accesses: DataFrame, seconds: int = SECONDS, delay: str = "1 minute") -> DataFrame:
    """Event-time sessions of each key with their count of accesses; late rows
    beyond the watermark go."""
    spans = F.session_window("ts", f"{seconds} seconds")
    return accesses.withWatermark("ts", delay).groupBy("session_key", spans.alias("span")).agg(F.count("*").alias("n_accesses"))


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed pages from a folder of Parquet files as they arrive; stateless."""
    pages = spark.readStream.schema("page_id long, url string, html string").parquet(folder)
    return parsed_pages(pages)
