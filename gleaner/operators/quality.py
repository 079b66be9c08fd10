"""Citation filter and the page quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Quality
from ..functions import text

# Patterns of citations, and of fragments of them in short sentences.
MONTHS = "(january|february|march|april|may|june|july|august|september|october|november|december)"
CITATIONS = [
    r"""(?i)^\^\s*([a-z]\s*)*["'\w]""",
    r"(?i)\bretrieved\s+\d{1,2}\s+\w+\s+\d{4}",
    r"(?i)\bretrieved\s+\w+\s+\d{1,2},?\s+\d{4}",
    r"(?i)\baccessed\s+\d{1,2}\s+\w+\s+\d{4}",
    r"(?i)\baccessed\s+\w+\s+\d{1,2},?\s+\d{4}",
    r"(?i)\barchived\s+from\s+(the\s+)?original",
    r"(?i)\bdoi\s*:\s*10\.\d+",
    r"(?i)\bisbn\s*[-:]?\s*[\d-]{10,}",
    r"(?i)\bpmid\s*[-:]?\s*\d+",
    r"(?i)\barxiv\s*[-:]?\s*[\d.]+",
    r"(?i)\bissn\s*[-:]?\s*[\d-]+",
    r"""^\[\d+\]\s*["'\w]""",
]
FRAGMENTS = [
    r"(?i)^[a-z][a-z0-9-]*\.(com|org|net|edu|gov|io|co\.uk)\.*\z",
    r"(?i)^retrieved\s+",
    r"(?i)^accessed\s+",
    r"(?i)^(github|arxiv|wired|ars\s*technica|the\s+register|lwn|nist|ieee|acm|cisa|suse|ubuntu|red\s*hat|openssf|bleepingcomputer|help\s+net\s+security|decipher|the\s+record|the\s+new\s+york\s+times|the\s+verge|omg!\s*ubuntu)\.*\z",
    rf"(?i)^\d{{1,2}}\s+{MONTHS}\s+\d{{4}}\.*\z",
    r"^([A-Z][a-z]*\s*){1,5}\.(\s+\d{1,2}\s+\w+\s+\d{4}\.?)?\z",
    rf"(?i)\.\s+\d{{1,2}}\s+{MONTHS}\s+\d{{4}}\.?\z",
]
#: As the SQL of the registered queries has them: sites with a blank in their name and trailing dates are not among them.
SQL_CITATIONS = [p.replace(r"\s", text.SQL_SPACE) for p in CITATIONS]
SQL_FRAGMENTS = [
    r"(?i)^[a-z][a-z0-9-]*\.(com|org|net|edu|gov|io|co\.uk)\.*\z",
    rf"(?i)^(retrieved|accessed){text.SQL_SPACE}+",
    r"(?i)^(github|arxiv|wired|lwn|nist|ieee|acm|cisa|suse|ubuntu|openssf|bleepingcomputer|decipher)\.*\z",
    FRAGMENTS[4].replace(r"\s", text.SQL_SPACE),
    FRAGMENTS[5].replace(r"\s", text.SQL_SPACE),
]
#: Something of this is in every citation; a single plain search spares most sentences the patterns.
CITATION_HINT = r"(?i)retrieved|accessed|archived|doi|isbn|pmid|arxiv|issn|^[\^\[]"
FRAGMENT_MOST = 50
LONG, SHORT = 50, 30


def _either(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def is_citation(sentence: Column, trimmed: bool = False, sql: bool = False) -> Column:
    s = sentence if trimmed else text.trim(sentence)
    whole = F.when(s.rlike(CITATION_HINT), s.rlike(_either(SQL_CITATIONS if sql else CITATIONS))).otherwise(F.lit(False))
    return whole | F.when(text.length(s, sql) < FRAGMENT_MOST, s.rlike(_either(SQL_FRAGMENTS if sql else FRAGMENTS))).otherwise(F.lit(False))


def without_citations(sentences: DataFrame, keys: tuple[str, ...] = ("page_id",), sql: bool = False) -> DataFrame:
    """Drops citations (sentences come trimmed); ``pos`` numbers what is left, global_index stays."""
    order = Window.partitionBy(*keys).orderBy("global_index")
    return sentences.where(~is_citation(F.col("text"), trimmed=True, sql=sql)).withColumn("pos", F.row_number().over(order) - 1)


def reject_reason(n: Column, long: Column, fragments: Column, median: Column, q: Quality = Quality()) -> Column:
    """The first rule that fails, null if none does."""
    share = fragments / F.nullif(n, F.lit(0))
    return (
        F.when(n == 0, F.lit("No sentences found"))
        .when(n < q.min_sentences, F.format_string(f"Too few sentences (%d < {q.min_sentences})", n))
        .when(long < q.min_long, F.format_string(f"Too few long sentences (%d < {q.min_long})", long))
        .when(share > q.max_fragments, F.format_string(f"Too many fragments (%.0f%%%% > {100 * q.max_fragments:g}%%%%)".replace("%%%%", "%%"), share * 100))
        .when(median < q.min_median, F.format_string(f"Median sentence too short (%.0f < {q.min_median:g})", median))
    )


def page_quality(sentences: DataFrame, q: Quality = Quality(), keys: tuple[str, ...] = ("page_id",), sql: bool = False) -> DataFrame:
    """Counts, median and reason (null: passes) of each page with sentences."""
    size = text.length(F.col("text"), sql)
    counted = sentences.groupBy(*keys).agg(
        F.count("*").alias("n_sentences"),
        F.count_if(size > LONG).alias("n_long"),
        F.count_if(size < SHORT).alias("n_fragments"),
        F.coalesce(F.median(size), F.lit(0.0)).alias("median_length"),
    )
    c = F.col
    return counted.withColumns({
        "fragment_ratio": F.coalesce(c("n_fragments") / F.nullif(c("n_sentences"), F.lit(0)), F.lit(1.0)),
        "reject_reason": reject_reason(c("n_sentences"), c("n_long"), c("n_fragments"), c("median_length"), q),
    }).withColumn("passes", F.col("reject_reason").isNull())
