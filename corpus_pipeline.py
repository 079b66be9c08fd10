"""From raw documents to packed sequences: five stages over all rows.

Each stage reads what its predecessor wrote and its decisions take effect:
toxic documents go, repeated lines go, one document of each near-duplicate class
stays, secrets are masked, and what is left is packed. Stages take and return the
columns of documents; other columns of the input are dropped. Null and empty texts and
null ids pass; rows that repeat an id and its text count as copies of each other; an
empty table gives no rows. The tables of a stage go once the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from gleaner.llm import line_dedup, ngram_join, packing, secret_scan, toxicity
from gleaner.llm.common import table
from gleaner.llm.queries import vocabulary
from gleaner.session import materialize, scratch
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the model learns from the labels of the
    documents at hand, outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs.select(COLUMNS), model).where("score < 0.5").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.apply_bitmaps(docs.select(COLUMNS), line_dedup.line_bitmaps(docs))
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs.select(COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs.select(COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", keep_one_of_each),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the learned grammar nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as hand_on:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as keep:
                docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        return hand_on(materialize(STAGES[-1][1](spark, docs, sf_dir), "packed"))
