"""URL functions and search-operator parsing as Column expressions.

Host and path are taken once, by ``parts``: lower-case host, path "/" if empty,
both null for what is no URL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Blocked hosts, and what is stripped from hosts and paths, in order.
BLOCKED = ["medium.com", "npmjs.com", "researchgate.net", "grokipedia.org"]
HOST_PREFIXES = [r"(?i)^v\d+\.", r"^\d+\.\d+\.", r"(?i)^(stable|latest|current|docs)\.", r"(?i)^[a-z]{2}\.", r"(?i)^[a-z]{2}-[a-z]{2}\."]
PATH_SEGMENTS = [r"(?i)/v\d+(\.\d+)*/", r"/\d+\.\d+(\.\d+)*/", r"(?i)/(stable|latest|current|master|main|dev|nightly)/", r"(?i)/(en|en-us|en-gb)/"]


def _encoded(url: Column) -> Column:
    return F.replace(text.trim(url), F.lit(" "), F.lit("%20"))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(_encoded(url), F.lit("HOST")))


def path(url: Column) -> Column:
    found = F.try_parse_url(_encoded(url), F.lit("PATH"))
    return F.when(host(url).isNull(), F.lit(None)).otherwise(F.when(F.coalesce(found, F.lit("")) == "", F.lit("/")).otherwise(found))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def is_repository_front(url: Column) -> Column:
    return F.coalesce((bare_host(url) == "github.com") & (F.size(segments(url)) == 2), F.lit(False))


def is_blocked(url: Column) -> Column:
    name = bare_host(url)
    listed = reduce(lambda a, d: a | (name == d) | name.endswith("." + d), BLOCKED, F.lit(False))
    return F.coalesce(listed, F.lit(False)) | is_repository_front(url)


def dedup_key(url: Column) -> Column:
    """Host and path without version and language parts; the URL itself if it is none."""
    h = reduce(lambda c, p: F.regexp_replace(c, p, ""), HOST_PREFIXES, host(url))
    p = reduce(lambda c, x: F.regexp_replace(c, x, "/"), PATH_SEGMENTS, path(url))
    return F.coalesce(F.concat(h, F.regexp_replace(p, "/+", "/")), url)


def path_words(url: Column, sql: bool = False) -> Column:
    """Tokens of the path, before stemming."""
    return F.coalesce(F.flatten(F.transform(segments(url), lambda s: text.tokens(F.replace(s, F.lit("-"), F.lit(" ")), sql=sql))), F.array().cast("array<string>"))


def domain(url: Column) -> Column:
    return F.coalesce(bare_host(url), url)


def short(url: Column) -> Column:
    p = path(url)
    return F.coalesce(F.concat(bare_host(url), F.when(F.length(p) > 40, F.concat(F.substring(p, 1, 37), F.lit("..."))).otherwise(p)), url)


def without_operators(query: Column) -> Column:
    """The query's words, without site:, filetype:, -word, quotes and OR/AND between sites."""
    steps = [
        (r"(?i)\bsite:[\w.-]+\s+(OR|AND)\s+(?=site:)", ""),
        (r"(?i)\bsite:[\w.-]+", ""),
        (r"(^|\s)-\w+", " "),
        (r"(?i)\bfiletype:\w+", ""),
        (r'"([^"]+)"', "$1"),
    ]
    return text.collapse(reduce(lambda c, s: F.regexp_replace(c, *s), steps, query))


def session_key(url: Column, words: Column) -> Column:
    return F.concat(url, F.lit(":"), F.array_join(F.array_sort(F.array_distinct(words)), ","))
