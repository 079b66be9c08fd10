"""DuckDB SQL that states what each registered query returns.

Built from a few named subqueries: blocks, sentences and tokens of documents and
of pages, page statistics, and scores. Tokens are not stemmed here.
"""

from __future__ import annotations

from .functions.text import ABBREVIATIONS, STOP_WORDS
from .operators.scoring import META_HEADINGS, META_PHRASES, WEIGHTS

QUERY = ["thtion", "attion", "ertion", "thtion", "retion"]


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(c: str) -> str:
    camel = f"regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    words = f"string_split(trim(regexp_replace(regexp_replace(lower({camel}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
    return f"list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains({_list(STOP_WORDS)}, w))"


def _sentence_list(c: str) -> str:
    short = f"'(^|[^A-Za-z0-9_])((?i:{'|'.join(ABBREVIATIONS)}))\\. ([A-Z])', '\\1\\2.' || chr(2) || '\\3', 'g'"
    held = f"regexp_replace(regexp_replace({c}, {short}), {short})"
    # twice: one pass cannot split both sides of a one-letter sentence
    cut = f"regexp_replace(regexp_replace({held}, '([.!?]) ([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '([.!?]) ([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(replace(s, chr(2), ' '))), lambda s: s <> '')"


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"

_DOC_BLOCKS = f"""
blocks AS (
  SELECT page_id, unnest(l) AS block, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS block_index, len(l) AS n_blocks,
    'p' AS block_type, CAST([] AS VARCHAR[]) AS heading_path
  FROM (SELECT doc_id AS page_id, {_LINES} AS l FROM documents))"""

_CLEAN = "trim(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_PAGE_BLOCKS = f"""
marked AS (
  SELECT page_id, list_filter(list_transform(string_split(replace(replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<h1>', chr(1) || 'h1'), '<p>', chr(1) || 'p '), chr(1)),
    lambda y: {{'t': trim(left(y, 2)), 'x': {_CLEAN.replace("regexp_replace(x, '<", "regexp_replace(substr(y, 3), '<")}}}), lambda b: b.x <> '') AS l
  FROM pages),
blocks AS (
  SELECT page_id, unnest(l).x AS block, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS block_index, len(l) AS n_blocks, unnest(l).t AS block_type,
    CASE WHEN unnest(l).t = 'h1' OR len(list_filter(l, lambda b: b.t = 'h1')) = 0 THEN CAST([] AS VARCHAR[]) ELSE [list_filter(l, lambda b: b.t = 'h1')[1].x] END AS heading_path
  FROM marked)"""

_SENTENCES = f"""
split AS (
  SELECT page_id, block_index, n_blocks, block_type, heading_path, CASE WHEN block_type LIKE 'h%' THEN [block] ELSE {_sentence_list("block")} END AS l FROM blocks),
flat AS (
  SELECT page_id, block_index, n_blocks, block_type, heading_path, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS sentence_index FROM split),
sentences AS (
  SELECT page_id, block_index, sentence_index, block_type, heading_path, text,
    CAST(row_number() OVER (PARTITION BY page_id ORDER BY block_index, sentence_index) - 1 AS INTEGER) AS global_index,
    CASE WHEN n_blocks > 1 THEN block_index / CAST(n_blocks - 1 AS DOUBLE) ELSE 0.0 END AS position,
    {tokens("text")} AS tokens
  FROM flat)"""

DOC_BLOCKS, PAGE_BLOCKS = _DOC_BLOCKS, _PAGE_BLOCKS
DOC_SENTENCES = f"WITH {_DOC_BLOCKS}, {_SENTENCES}"
PAGE_SENTENCES = f"WITH {_PAGE_BLOCKS}, {_SENTENCES}"

# RE2's $ without flags is the end of the text, as \z is elsewhere.
CITATION_SQL = """(regexp_matches(t, '(?i)^\\^\\s*([a-z]\\s*)*["''\\w]') OR regexp_matches(t, '(?i)\\bretrieved\\s+\\d{1,2}\\s+\\w+\\s+\\d{4}')
  OR regexp_matches(t, '(?i)\\bretrieved\\s+\\w+\\s+\\d{1,2},?\\s+\\d{4}') OR regexp_matches(t, '(?i)\\baccessed\\s+\\d{1,2}\\s+\\w+\\s+\\d{4}')
  OR regexp_matches(t, '(?i)\\baccessed\\s+\\w+\\s+\\d{1,2},?\\s+\\d{4}') OR regexp_matches(t, '(?i)\\barchived\\s+from\\s+(the\\s+)?original')
  OR regexp_matches(t, '(?i)\\bdoi\\s*:\\s*10\\.\\d+') OR regexp_matches(t, '(?i)\\bisbn\\s*[-:]?\\s*[\\d-]{10,}') OR regexp_matches(t, '(?i)\\bpmid\\s*[-:]?\\s*\\d+')
  OR regexp_matches(t, '(?i)\\barxiv\\s*[-:]?\\s*[\\d.]+') OR regexp_matches(t, '(?i)\\bissn\\s*[-:]?\\s*[\\d-]+') OR regexp_matches(t, '^\\[\\d+\\]\\s*["''\\w]')
  OR (length(t) < 50 AND (regexp_matches(t, '(?i)^[a-z][a-z0-9-]*\\.(com|org|net|edu|gov|io|co\\.uk)\\.*$') OR regexp_matches(t, '(?i)^(retrieved|accessed)\\s+')
    OR regexp_matches(t, '^([A-Z][a-z]*\\s*){1,5}\\.(\\s+\\d{1,2}\\s+\\w+\\s+\\d{4}\\.?)?$')
    OR regexp_matches(t, '(?i)^\\d{1,2}\\s+(january|february|march|april|may|june|july|august|september|october|november|december)\\s+\\d{4}\\.*$')
    OR regexp_matches(t, '(?i)^(github|arxiv|wired|lwn|nist|ieee|acm|cisa|suse|ubuntu|openssf|bleepingcomputer|decipher)\\.*$'))))"""

_KEPT = f"""
kept AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY global_index) - 1 AS INTEGER) AS pos
  FROM sentences WHERE NOT {CITATION_SQL.replace("(t,", "(trim(text),").replace("length(t)", "length(trim(text))")})"""

_Q = _list(QUERY)
_STATS = f"""
counts AS (SELECT page_id, CAST(count(*) AS INTEGER) AS n, avg(len(tokens)) AS avgdl FROM kept GROUP BY page_id),
terms AS (SELECT page_id, unnest(list_distinct(list_filter(tokens, lambda w: list_contains({_Q}, w)))) AS term FROM kept),
dfs AS (SELECT page_id, term, count(*) AS df FROM terms GROUP BY page_id, term),
weights AS (
  SELECT c.page_id, c.n, c.avgdl, list(coalesce(d.df, 0) ORDER BY x.i) AS df, list(ln((c.n - coalesce(d.df, 0) + 0.5) / (coalesce(d.df, 0) + 0.5) + 1) ORDER BY x.i) AS idf
  FROM counts c CROSS JOIN (SELECT unnest({_Q}) AS term, generate_subscripts({_Q}, 1) AS i) x LEFT JOIN dfs d ON d.page_id = c.page_id AND d.term = x.term
  GROUP BY c.page_id, c.n, c.avgdl),
base AS (
  SELECT k.*, w.n, w.avgdl, w.df, w.idf, list_transform({_Q}, lambda t: len(list_filter(k.tokens, lambda x: x = t))) AS tf,
    list_distinct(list_filter(k.tokens, lambda x: list_contains({_Q}, x))) AS matched, len(k.tokens) AS dl
  FROM kept k JOIN weights w USING (page_id)),
bm AS (
  SELECT *, list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN tf[i] = 0 THEN 0.0 ELSE idf[i] * (tf[i] * 2.5) / (tf[i] + 1.5 * (1 - 0.75 + 0.75 * coalesce(dl / nullif(avgdl, 0), 0))) END)) AS raw_bm25,
    CASE WHEN dl = 0 THEN 0.0 ELSE len(list_filter(tokens, lambda x: list_contains({_Q}, x))) / CAST(dl AS DOUBLE) END AS raw_density,
    list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN tf[i] > 0 THEN 1 ELSE 0 END)) / 5.0 AS overlap
  FROM base)"""

STATS = f"{_KEPT}, {_STATS}"


def scored() -> str:
    """From bm to every heuristic and the rank."""
    meta = "(?i)" + "|".join(f"(?:{p[:-2] + '$' if p.endswith(chr(92) + 'z') else p})" for p in META_HEADINGS)
    phrases = " OR ".join(f"contains(lower(text), {_quoted(p)})" for p in META_PHRASES)
    q_distinct = list(dict.fromkeys(QUERY))
    path_hit = " OR ".join(f"contains(lower(h), {_quoted(t)})" for t in q_distinct)
    total = " + ".join(f"h_{k} * {v}" for k, v in WEIGHTS.items())
    reach = "list_max(list_transform(matched, lambda t: coalesce(nullif(list_position(list_slice(tokens, i, dl), t), 0), 1000000)))"
    return f"""
dens AS (SELECT *, median(raw_density) OVER (PARTITION BY page_id) AS density_median FROM bm),
mads AS (SELECT *, greatest(0.001, median(abs(raw_density - density_median)) OVER (PARTITION BY page_id)) AS density_mad, {tokens("array_to_string(heading_path, ' ')")} AS path_tokens,
    CASE WHEN block_type LIKE 'h%' THEN {{'pos': pos, 'tokens': tokens}} END AS head FROM dens),
heads AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM mads),
parts AS (
  SELECT *, list_sum(list_transform({_Q}, lambda t: CASE WHEN list_contains(above.tokens, t) THEN 1 ELSE 0 END)) / 5.0 AS head_share, 1 / (1 + (pos - above.pos) / 5.0) AS head_near,
    list_min(list_transform(list_filter(range(1, dl + 1), lambda i: list_contains({_Q}, tokens[i])), lambda i: {reach})) AS span,
    sum(CASE WHEN overlap > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, block_index) - CASE WHEN overlap > 0.3 THEN 1 ELSE 0 END AS beside,
    (raw_density - density_median) / density_mad AS z, list_sum(idf) AS idf_all
  FROM heads),
h AS (
  SELECT *,
    CASE WHEN position <= 0.3 THEN 1 - position / 0.3 * 0.3 WHEN position <= 0.7 THEN 0.7 - (position - 0.3) / 0.4 * 0.2 ELSE 0.5 - (position - 0.7) / 0.3 * 0.2 END AS h_position,
    CASE WHEN above IS NULL THEN 0.3 WHEN head_share > 0 THEN least(1.0, head_share * 0.6 + head_near * 0.4) ELSE head_near * 0.5 END AS h_heading_proximity,
    CASE WHEN dl = 0 THEN 0.0 ELSE raw_density * 0.4 + len(matched) / 5.0 * 0.6 END AS h_density,
    least(1.0, CAST(CASE block_type WHEN 'p' THEN 0.8 WHEN 'li' THEN 0.7 WHEN 'pre' THEN 0.65 ELSE 0.4 END + CASE WHEN beside > 0 THEN 0.15 ELSE 0 END
      + CASE WHEN len(list_filter(heading_path, lambda h: {path_hit})) > 0 THEN 0.1 ELSE 0 END AS DOUBLE)) AS h_structure,
    CASE WHEN len(matched) = 0 THEN 0.0 WHEN len(matched) = 1 THEN len(matched) / 5.0 * 0.5
      ELSE len(matched) / 5.0 * 0.4 + (1 - least(1.0, span / CAST(dl AS DOUBLE))) * 0.35 + least(1.0, len(matched) / CAST(span AS DOUBLE)) * 0.25 END AS h_proximity,
    CASE WHEN len(heading_path) = 0 OR len(path_tokens) = 0 THEN 0.3
      ELSE 0.3 + 0.7 * coalesce(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN list_contains(path_tokens, {_Q}[i]) THEN idf[i] ELSE 0.0 END)) / nullif(idf_all, 0), 0) END AS h_heading_path,
    CASE WHEN dl = 0 THEN 0.0 ELSE 0.7 * coalesce(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN tf[i] > 0 THEN idf[i] ELSE 0.0 END)) / nullif(idf_all, 0), 0) + 0.3 * overlap END AS h_coverage,
    CASE WHEN dl = 0 OR z <= 0 THEN 0.3 ELSE 0.3 + 0.7 / (1 + exp(-(z - 2))) END AS h_outlier,
    CASE WHEN len(list_filter(heading_path, lambda h: regexp_matches(trim(h), {_quoted(meta)}))) > 0 THEN 0.2 WHEN {phrases} THEN 0.3 ELSE 1.0 END AS h_meta_section
  FROM parts),
sums AS (SELECT *, {total} AS heuristic_score, min(raw_bm25) OVER (PARTITION BY page_id) AS lo, max(raw_bm25) OVER (PARTITION BY page_id) AS hi FROM h),
norm AS (SELECT *, CASE WHEN hi = lo THEN 0.5 ELSE (raw_bm25 - lo) / (hi - lo) END AS bm25_score FROM sums),
scores AS (SELECT *, 0.6 * bm25_score + 0.4 * heuristic_score AS combined_score FROM norm)"""


def page(extra: str, select: str) -> str:
    return f"{PAGE_SENTENCES}, {extra} {select}"


def doc(extra: str, select: str) -> str:
    return f"{DOC_SENTENCES}{', ' + extra if extra else ''} {select}"


RELEVANCE = """
pages_seen AS (
  SELECT page_id, any_value(n) AS n, greatest(0.0, max(raw_bm25)) AS best, max(len(matched)) AS together, any_value(df) AS df FROM bm GROUP BY page_id),
rel AS (
  SELECT page_id, n, best, together, (SELECT count(*) FROM (SELECT DISTINCT unnest(list_filter(list_zip({q}, df), lambda p: p[2] > 0))[1])) / 5.0 AS cover_raw, df,
    len(list_distinct(list_filter(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN df[i] > 0 THEN {q}[i] END), lambda t: t IS NOT NULL))) / 5.0 AS cover,
    len(list_filter(df, lambda d: d >= greatest(3.0, n * 0.1))) > 0 AS central FROM pages_seen)""".replace("{q}", _Q).replace(
    "(SELECT count(*) FROM (SELECT DISTINCT unnest(list_filter(list_zip(" + _Q + ", df), lambda p: p[2] > 0))[1])) / 5.0 AS cover_raw, ", ""
)

# URLs of the pages table: scheme, host, optional port and path; lower-case hosts.
HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1))"
PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/')"
