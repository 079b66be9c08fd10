"""Repeated passages against a table of all windows."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from gleaner.llm import queries
from gleaner.llm import suffix_dedup as S


def brute(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + S.SPAN] for d in data for i in range(len(d) - S.SPAN + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - S.SPAN + 1):
            if seen[d[i : i + S.SPAN]] > 1:
                gone[i : i + S.SPAN] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), len(S._ranges(gone)), S.digest(kept)))
    return out


def corpus() -> list[tuple]:
    pick = random.Random(6)
    words = ["the", "naïve", "token", "中文", "of", "passage"] + [f"v{i}" for i in range(200)]

    def text(n: int) -> str:
        return " ".join(pick.choices(words, k=n))

    passages = [text(120) for _ in range(6)]
    rows: list[tuple] = []
    for i in range(120):
        parts = [text(pick.randint(1, 80))]
        for _ in range(pick.choice([0, 0, 1, 2])):
            p = pick.choice(passages)
            a = pick.choice([0, 0, pick.randint(0, 200)])
            parts += [p[a : a + pick.choice([200, 399, 400, 401, 450, 2000])], text(pick.randint(1, 40))]
        rows.append((i, " ".join(parts), "x"))
    rows += [(200, None, "x"), (201, "", "x"), (None, rows[3][1], "x"), (5, rows[5][1], "x"), (5, rows[5][1], "x")]
    rows += [(300, "a" * 1500, "x"), (301, "ab" * 399 + "a", "x"), (302, passages[0] + passages[0], "x"), (303, "z" * 400, "x"), (304, "y" * 399, "x")]
    for i in range(40):  # near copies: an edit every few hundred bytes
        copy = list(passages[1] * 4)
        for _ in range(6):
            copy[pick.randrange(len(copy))] = "#"
        rows.append((400 + i, "".join(copy), "x"))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, bytes string"), sorted(((i, *b) for (i, *_), b in zip(rows, brute([t for _, t, _ in rows]))), key=repr)


@pytest.mark.parametrize("collection", [S.COLLECTION, 5])
def test_equals_brute_force(found, collection):
    docs, want = found
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), S.digest(bytes(r["kept"]))) for r in S.remove_repeats(docs, collection).collect()]
    assert sorted(got, key=repr) == want


def shared_words(rows) -> list[tuple]:
    """By a table of all windows of 51 words and the ids that hold them."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    holders = defaultdict(set)
    for (i, *_), w in zip(rows, words):
        for a in range(len(w) - 50):
            holders[tuple(w[a : a + 51])].add(i)
    return sorted(((i, len({b for a in range(len(w) - 50) if len(holders[tuple(w[a : a + 51])]) > 1 for b in range(a, a + 51)})) for (i, *_), w in zip(rows, words)), key=repr)


def test_shared_passages(spark, found):
    pick = random.Random(12)
    short = [" ".join(pick.choices(["to", "a", "of", "it", "we"], k=n)) for n in (49, 50, 51, 52, 60, 75)]
    rows = corpus() + [(500 + i, f"head {i} {short[i % 6]} tail {i} " + " ".join(str(pick.random()) for _ in range(i)), "x") for i in range(60)] + [(600, f"{short[4]} {short[4]}", "x"), (601, f"{short[5]} 9", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(5)
    assert sorted(((r["doc_id"], r["n_passage_words"]) for r in S.remove_repeats(docs).collect()), key=repr) == shared_words(rows)


def test_query(spark, found, tmp_path):
    docs, want = found
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_equal_windows_of_one_collection_beyond_its_size(spark):
    """As many runs of one anchor as split down to single windows, and beyond."""
    pick = random.Random(3)
    middle = "".join(pick.choices("abcdefghij ", k=380))
    rows = [(i, f"{i % 7} {pick.random()} {'xy'[i % 2] * 12}{middle}{'pq'[i % 3 % 2] * 14} {pick.random()}", "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), S.digest(bytes(r["kept"]))) for r in S.remove_repeats(docs, 4).collect()]
    assert sorted(got) == sorted((i, *b) for (i, *_), b in zip(rows, brute([t for _, t, _ in rows])))
    assert sum(r[2] for r in got) > 0


def test_tables_are_written_without_checksum_files(found):
    tables = {os.path.dirname(f.removeprefix("file://")) for f in S.remove_repeats(found[0]).inputFiles() if "/gleaner-" in f}
    assert tables and not any(name.endswith(".crc") for t in tables for name in os.listdir(t))


def test_empty(found):
    assert S.remove_repeats(found[0].limit(0)).count() == 0


def test_runs_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1000)
    texts = [t.encode() for _, t, _ in corpus()[:30] if t] + [b"q" * 5000]
    owner, *_, first, last = S.text_runs(texts)
    for i, t in enumerate(texts):
        own = sorted(x for a, b in zip(first[owner == i], last[owner == i]) for x in range(a, b + 1))
        assert own == list(range(max(0, len(t) - S.SPAN + 1)))


def test_columnwise_order():
    pick = random.Random(8)
    segments = ["".join(pick.choices("ab", k=pick.randint(6, 14))).encode() for _ in range(60)]
    leads = [pick.randint(0, 3) for _ in segments]
    counts = [len(s) - 4 for s in segments]
    marks = S.repeated_windows(segments, leads, counts, span=5)
    seen = Counter((w - lead, s[w : w + 5]) for s, lead, n in zip(segments, leads, counts) for w in range(n))
    for s, lead, n, mask in zip(segments, leads, counts, marks):
        assert mask.tolist() == [seen[w - lead, s[w : w + 5]] > 1 for w in range(n)]
