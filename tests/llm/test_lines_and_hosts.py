"""Line dedup and host rules against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from gleaner.llm import host_rules, line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines int"
LINE = "this passage of more than forty characters repeats"
ROWS = [
    (1, f"head\n  {LINE.upper()}\ntail one", "a", 1),
    (2, f"{LINE}\n{LINE}", "a", 2),
    (3, LINE, "a", 3),
    (4, f"x\n{LINE}\t", "b", None),
    (9, f"{LINE}\nlast\n{LINE}", None, 5),
    (9, f"{LINE}\nlast\n{LINE}", None, 5),
    (5, None, None, 0),
    (6, "", "b", 0),
    (7, "\n".join(f"line {i % 700} of a very long text that has many more characters" for i in range(3000)), "b", 0),
    (None, "one two three one two three one two three " * 20, "c", 0),
    (8, "word # $ | " * 30 + "\nsame\nsame\n same", "c", 0),
]


def test_line_dedup(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((r["doc_id"] or -1, r["text"] or "", r["n_lines"], r["n_dropped"]) for r in line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).collect())
    holders = defaultdict(set)
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)

    def key(x: str) -> str:
        return x.strip(line_dedup.BLANKS).translate(low)

    for i, text, *_ in ROWS:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(-1 if i is None else i)
    want = []
    for i, text, *_ in ROWS:
        i = -1 if i is None else i
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i)]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got == sorted(want)


def test_columns_with_the_names_of_keys_pass(spark):
    docs = spark.createDataFrame([(r[0], r[1], "a", b"b") for r in ROWS], "doc_id long, text string, __doc string, bitmap binary")
    cut = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    assert cut.columns == [*docs.columns, "n_lines", "n_dropped"] and {(r["__doc"], r["bitmap"]) for r in cut.collect()} == {("a", b"b")}


@pytest.mark.parametrize("seed", range(30))
def test_stream_decides_first_occurrences(seed):
    """Sorted rows cut into any partitions and batches: the streamed losers and the
    edges leave each hash's largest document, and nothing else decides."""
    pick = random.Random(seed)
    rows = sorted({(h, -pick.randint(0, 6), p) for h in range(pick.randint(1, 8)) for p in range(pick.randint(1, 12))})
    table = [(-d, 0, p, h, h) for h, d, p in rows]
    cuts = sorted(pick.choices(range(len(table) + 1), k=pick.randint(0, 5)))
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(table)]):
        batches, at = [], a
        while at < b:
            n = min(b - at, pick.randint(1, 5))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table[at : at + n]), kinds)], ["__doc", "__text_hash", "pos", "h1", "h2"]))
            at += n
        out += [r for x in line_dedup._first_occurrences(iter(batches)) for r in x.to_pylist()]
    first = {}
    for r in out:
        if r["edge"]:
            first[r["h1"]] = max(first.get(r["h1"], -1), r["__doc"])
    lost = {(r["h1"], r["__doc"], r["pos"]) for r in out if not r["edge"] or r["__doc"] != first[r["h1"]]}
    keeper = {h: max(-d for g, d, _ in rows if g == h) for h, _, _ in rows}
    assert lost == {(h, -d, p) for h, d, p in rows if -d != keeper[h]}


def test_line_dedup_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).count() == 0


def plain_metrics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in host_rules.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_host_rules(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = host_rules.judge(docs).collect()
    got = sorted(((r["doc_id"] or -1), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    want = []
    for i, text, *_ in ROWS:
        m = plain_metrics(text)
        want.append((i or -1, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert host_rules.judge(docs.limit(0)).count() == 0


def test_bad_host_drops_only_soft_failures(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "short", "bad", 0) for i in range(40)] + [(100, clean, "bad", 0), (101, clean + " ###" * 20, "bad", 0), (102, clean + " ###" * 20, "good", 0)]
    rows += [(200 + i, clean, "good", 0) for i in range(40)]
    kept = {r["doc_id"]: r["kept"] for r in host_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept[100] and not kept[101] and kept[102] and not kept[0]
