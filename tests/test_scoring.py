"""Scores, relevance and rank against a plain computation, row by row."""

from __future__ import annotations

import math
import random
from statistics import median

import pytest
from gleaner.operators import scoring as S
from pyspark.sql import functions as F

SCHEMA = "query_id long, page_id long, pos int, at int, global_index int, block_index int, position double, block_type string, text string, tokens array<string>, heading_path array<string>, path_tokens array<string>, q array<string>"


def group(query_id: int, q: list[str], sentences: list[dict]) -> list[tuple]:
    out = []
    for i, s in enumerate(sentences):
        path = s.get("path", [])
        out.append((query_id, 1, i, i, i, s.get("block", i), i / max(1, len(sentences) - 1), s.get("type", "p"), s.get("text", " ".join(s["tokens"])), s["tokens"], path, [w for p in path for w in p.split()], q))
    return out


def plain(rows: list[tuple]) -> list[dict]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [dict(zip(names, r)) for r in rows]
    q, n = rows[0]["q"], len(rows)
    avg = sum(len(r["tokens"]) for r in rows) / n
    df = {t: sum(t in r["tokens"] for r in rows) for t in q}
    idf = {t: math.log((n - d + 0.5) / (d + 0.5) + 1) for t, d in df.items()}
    dense = [sum(t in q for t in r["tokens"]) / len(r["tokens"]) if r["tokens"] else 0 for r in rows]
    mid = median(dense)
    mad = max(0.001, median(abs(d - mid) for d in dense))
    share = [sum(t in r["tokens"] for t in q) / len(q) for r in rows]
    total = sum(idf[t] for t in q)
    out = []
    for i, r in enumerate(rows):
        w, have = r["tokens"], set(r["tokens"]) & set(q)
        bm = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in q if t in w)
        heads = [j for j in range(i) if rows[j]["block_type"][0] == "h"]
        if heads:
            over = sum(t in rows[heads[-1]]["tokens"] for t in q) / len(q)
            near = 1 / (1 + (i - heads[-1]) / 5)
            prox = min(1, over * 0.6 + near * 0.4) if over else near * 0.5
        else:
            prox = 0.3
        p = r["position"]
        base = {"p": 0.8, "li": 0.7, "pre": 0.65}.get(r["block_type"], 0.4)
        base += 0.15 * any(j != i and rows[j]["block_index"] == r["block_index"] and share[j] > 0.3 for j in range(n))
        base += 0.1 * any(t in h.lower() for h in r["heading_path"] for t in q)
        base += 0.1 * (r["block_type"] != "pre" and any(rows[j]["block_type"] == "pre" for j in range(max(0, i - 2), min(n, i + 3))))
        if len(have) > 1:
            span = min(b - a + 1 for a in range(len(w)) for b in range(a, len(w)) if have <= set(w[a : b + 1]))
            close = len(have) / len(q) * 0.4 + (1 - min(1, span / len(w))) * 0.35 + min(1, len(have) / span) * 0.25
        else:
            close = len(have) / len(q) * 0.5
        z = (dense[i] - mid) / mad
        out.append({
            "raw_bm25": bm,
            "h_position": 1 - p if p <= 0.3 else 0.7 - (p - 0.3) / 2 if p <= 0.7 else 0.5 - (p - 0.7) * 2 / 3,
            "h_heading_proximity": prox,
            "h_density": 0.4 * dense[i] + 0.6 * len(have) / len(q) if w else 0,
            "h_structure": min(1, base),
            "h_proximity": close,
            "h_heading_path": 0.3 + 0.7 * sum(idf[t] for t in q if t in r["path_tokens"]) / total if r["path_tokens"] else 0.3,
            "h_coverage": 0.7 * sum(idf[t] for t in q if t in w) / total + 0.3 * share[i] if w else 0,
            "h_outlier": 0.3 if not w or z <= 0 else 0.3 + 0.7 / (1 + math.exp(2 - z)),
        })
    return out


def random_page(seed: int) -> tuple[list[str], list[dict]]:
    pick = random.Random(seed)
    words = ["hook", "state", "react", "use", "other", "thing", "word", "more"]
    sentences, path = [], []
    for i in range(pick.randint(1, 25)):
        kind = pick.choice(["p", "p", "p", "li", "pre", "h2"])
        tokens = pick.choices(words, k=pick.randint(0, 12))
        sentences.append({"tokens": tokens, "type": kind, "path": list(path), "block": i // 2})
        if kind == "h2":
            path = [" ".join(tokens)]
    return pick.choices(words[:4], k=pick.randint(1, 4)), sentences


@pytest.fixture(scope="module")
def random_pages(spark):
    groups = [group(i, *random_page(i)) for i in range(40)]
    rows = spark.createDataFrame([r for g in groups for r in g], SCHEMA)
    return groups, S.ranked(rows).orderBy("query_id", "pos").collect()


def test_scores_equal_plain(random_pages):
    groups, rows = random_pages
    want = [x for g in groups for x in plain(g)]
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        for k, v in w.items():
            assert r[k] == pytest.approx(v, abs=1e-9), (k, r)
        assert r["heuristic_score"] == pytest.approx(sum(r[f"h_{k}"] * v for k, v in S.WEIGHTS.items()))


def test_rank_and_normalization(random_pages):
    _, rows = random_pages
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    for own in by.values():
        low, high = min(r["raw_bm25"] for r in own), max(r["raw_bm25"] for r in own)
        for r in own:
            assert r["bm25_score"] == pytest.approx((r["raw_bm25"] - low) / (high - low) if high > low else 0.5)
            assert r["combined_score"] == pytest.approx(0.6 * r["bm25_score"] + 0.4 * r["heuristic_score"])
        assert [r["global_index"] for r in sorted(own, key=lambda r: r["rank"])] == [r["global_index"] for r in sorted(own, key=lambda r: (-r["combined_score"], r["global_index"]))]


def test_weights_sum_to_one():
    assert sum(S.WEIGHTS.values()) == pytest.approx(1)


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame(group(1, ["hook"], [{"tokens": ["hook", "a1", "a2"]}, {"tokens": ["b1", "b2", "b3", "hook"]}, {"tokens": ["c1", "c2", "c3"]}]), SCHEMA)
    got = [r["raw_bm25"] for r in S.ranked(rows).orderBy("pos").collect()]
    assert got[0] == pytest.approx(math.log(1.6) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (10 / 3)))) and got[2] == 0


def test_repeated_query_token_counts_twice(spark):
    sentences = [{"tokens": ["hook", "x1"]}, {"tokens": ["y1"]}]
    rows = spark.createDataFrame(group(1, ["hook"], sentences) + group(2, ["hook", "hook"], sentences), SCHEMA)
    best = {r["query_id"]: r["raw_bm25"] for r in S.ranked(rows).where("pos = 0").collect()}
    assert best[2] == pytest.approx(2 * best[1])
    found = {r["query_id"]: r["coverage"] for r in S.relevance(rows, S.page_stats(rows)).collect()}
    assert found == {1: 1.0, 2: 0.5}


def test_words_of_object_prototypes_score(spark):
    rows = spark.createDataFrame(group(1, ["constructor"], [{"tokens": ["constructor"]}, {"tokens": ["x1"]}]), SCHEMA)
    assert S.ranked(rows).where("pos = 0").first()["raw_bm25"] > 0


@pytest.mark.parametrize("p, want", [(0.0, 1.0), (0.3, 0.7), (0.7, 0.5), (1.0, 0.3)])
def test_position(spark, p, want):
    assert spark.range(1).select(S.position_score(F.lit(p))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("path, text, want", [
    (["Introduction"], "x", 0.2), (["What's next?"], "x", 0.2), (["A", " See Also "], "x", 0.2), (["Introduction to X"], "x", 1.0), ([], "In This Article we go", 0.3), ([], "plain", 1.0),
])
def test_meta_section(spark, path, text, want):
    rows = spark.createDataFrame([(path, text)], "heading_path array<string>, text string")
    assert rows.select(S.meta_section_score()).first()[0] == want


@pytest.mark.parametrize("mode, best, cover, together, central, want", [
    ("strict", 1.1, 0.1, 2, False, True), ("strict", 1.0, 0.1, 2, False, False), ("strict", 0.81, 0.1, 1, True, True), ("strict", 0.6, 0.8, 1, False, True), ("strict", 0.5, 1.0, 1, False, False),
    ("search", 0.81, 0.25, 1, False, True), ("search", 0.51, 0.1, 2, False, True), ("search", 0.41, 0.1, 1, True, True), ("search", 0.31, 0.5, 1, False, True), ("search", 0.3, 0.5, 1, False, False),
])
def test_relevance_rules(spark, mode, best, cover, together, central, want):
    got = spark.range(1).select(S.relevant(mode, F.lit(best), F.lit(cover), F.lit(together), F.lit(central))).first()[0]
    assert got is want
