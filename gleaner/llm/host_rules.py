"""Quality rules with host-level verdicts, in DataFrame functions only.

Per document, word and line statistics come from array functions over the whole
text. Rule failures are then summed by host (map-side first, so a host with a
third of all rows is one small row per task), each host's failure rate is
shrunk towards an empirical beta prior fitted over all hosts, and the verdict
joins back to the documents on the host. A document is kept unless it fails a
base rule itself, or its host's shrunk rate is beyond ``host_rate`` and the
document fails one of the softer rules: clean documents of bad hosts stay.

Defined cases: null text has no words and one empty line; a null host is a host
of its own; repeated rows are judged one by one; an empty table gives an empty
result; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _shifted(items: Column) -> Column:
    """Pairs each item with its predecessor (null first); one longer at the end."""
    return F.concat(F.array(F.lit(None)), items)


def document_metrics(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules look at."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[host].cast("string").alias("host"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    words = F.filter(F.split("text", BLANK, -1), lambda w: w != "")
    full = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    split = base.select(
        "doc_id",
        "host",
        words.alias("words"),
        full.alias("full"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    grams = F.zip_with(
        F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice("words", 3, F.greatest(F.size("words"), F.lit(1))),
        lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab["a"], ab["b"], c)),
    )
    counted = split.select(
        "doc_id",
        "host",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.filter(grams, lambda g: g.isNotNull()).alias("grams"),
    )
    # Only texts with a repeated window pay for sorting windows with their places.
    placed = counted.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).otherwise(F.expr("cast(array() as array<struct<g: bigint, i: int>>)")),
    ).drop("grams")
    same = placed.withColumn("same", F.zip_with("placed", _shifted(F.col("placed")["g"]), lambda x, g: F.coalesce(x["g"] == g, F.lit(False))))
    places = F.zip_with(
        F.zip_with("placed", "same", lambda x, s: F.struct(x["i"].alias("i"), s.alias("s"))),
        F.slice("same", 2, F.greatest(F.size("same"), F.lit(1))),
        lambda x, following: F.when(x["s"] | F.coalesce(following, F.lit(False)), x["i"]),
    )
    spots = same.withColumn("spots", F.sort_array(F.filter(places, lambda i: i.isNotNull()))).drop("placed", "same")
    steps = F.zip_with("spots", F.slice("spots", 2, F.greatest(F.size("spots"), F.lit(1))), lambda i, following: F.least(F.lit(3), F.coalesce(following - i, F.lit(3))))
    return spots.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.aggregate(F.filter(steps, lambda s: s.isNotNull()), F.lit(0).cast("long"), lambda n, s: n + s).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    """Softer rules; they only count together with the host's verdict."""
    return (10 * F.col("n_symbols") > F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")) | (F.col("n_dup_lines") >= 3)


def host_verdicts(metrics: DataFrame, host_rate: float = 0.6) -> DataFrame:
    """host, n_docs, n_failed, rate (posterior mean under the fitted beta prior)
    and bad. The prior's mean and strength come from the moments of the hosts'
    raw rates: m and v give a + b = m(1-m)/v - 1, at least 1."""
    hosts = metrics.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum((base_failed() | soft_failed()).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # two numbers
    mean = m or 0.0
    strength = max(1.0, mean * (1 - mean) / v - 1) if v else 1e6
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk > host_rate).alias("bad"))


def judge(docs: DataFrame, host: str = "source", host_rate: float = 0.6) -> DataFrame:
    """One row per document: its metrics, base_failed, the host's rate and kept."""
    metrics = materialize(document_metrics(docs, host), "metrics")
    verdicts = host_verdicts(metrics, host_rate).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "bad")
    return metrics.join(verdicts, metrics["host"].eqNullSafe(verdicts["h"]), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~(F.col("bad") & soft_failed())).alias("kept"), "host_rate",
    )
