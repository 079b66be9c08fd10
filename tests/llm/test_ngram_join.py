"""Near-duplicate classes and links against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from gleaner.llm import ngram_join as N
from gleaner.llm import queries
from gleaner.llm.components import components

SCHEMA = "doc_id long, text string, class string"


def grams(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def corpus() -> list[tuple]:
    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)] + ["é\xa0x", "中"]
    rows, i = [], 0
    for group in range(40):
        base = pick.choices(vocabulary, k=pick.choice([3, 8, 60, 200, 400]))
        for _ in range(pick.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 6])):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            rows.append((i, pick.choice([" ", "\n"]).join(words), "x"))
            i += 1
    hot = pick.choices(vocabulary, k=150)
    for _ in range(400):
        words = list(hot)
        words[pick.randrange(150)] = pick.choice(vocabulary)
        rows.append((i, " ".join(words), "hot"))
        i += 1
    rows += [(i + k, None if k else "", "e") for k in range(3)] + [(7, rows[7][1], "again"), (None, rows[7][1], "none"), (None, "one two", "none"), (5, "other text of the id five", "tie")]
    rows += [(5000, "long " * 40_000 + "end", "long"), (5001, "long " * 40_000 + "end ", "long")]
    return rows


def brute(rows):
    sets = [grams(t) for _, t, _ in rows]
    kinds = sorted(set(sets), key=lambda s: sorted(s))
    number = {s: k for k, s in enumerate(kinds)}
    label = list(range(len(kinds)))
    links = [0] * len(kinds)

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, x in enumerate(kinds):
        for b in range(a):
            y = kinds[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    least = {}
    for (i, *_), s in zip(rows, sets):
        c = find(number[s])
        least[c] = min((v for v in (least.get(c), i) if v is not None), default=None)
    return sorted(((i, least[find(number[s])], links[number[s]]) for (i, *_), s in zip(rows, sets)), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_classes_and_links(docs):
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in N.classes(docs).collect()), key=repr)
    assert got == brute(corpus())


def test_one_of_each_class_stays(docs):
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, c, _ in brute(corpus())}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(want) and set(ids) == want


def test_empty(docs):
    assert N.classes(docs.limit(0)).count() == 0
    assert N.keep_one(docs.limit(0)).count() == 0


def test_pruning_keeps_similar_pairs():
    least = N.least_matches(0.8)
    assert len(least) == 6 and all(a < b for a, b in zip(least, least[1:])) and least[-1] < 0.8 * N.K
    random_ = np.random.default_rng(3)
    base = random_.integers(0, 1 << 32, (1, N.K)).astype(np.uint32)
    many = np.repeat(base, 500, axis=0)
    change = random_.random(many.shape) > 0.85
    many[change] = random_.integers(0, 1 << 32, change.sum())
    pairs = [N.surviving(np.concatenate([base, many]), np.arange(501) > 0, band, least) for band in range(N.K // N.BAND)]
    assert sum(len(i) for i, _ in pairs) >= 499  # each pair in the first band it shares
    assert len({j for _, found in pairs for j in found.tolist()}) == sum(len(i) for i, _ in pairs)
    far = random_.integers(0, 1 << 32, (500, N.K)).astype(np.uint32)
    far[:, : N.BAND] = base[:, : N.BAND]  # they share a band by chance
    i, _ = N.surviving(np.concatenate([base, far]), np.arange(501) > 0, 0, least)
    assert len(i) == 0


def test_candidates_of_a_chain_grow_with_its_length(spark):
    """Texts that each share most words with the next: buckets stay as small as in a
    short chain, although all texts hang together."""
    pick = random.Random(2)
    words = [pick.choice("abcdefgh") + str(pick.randrange(10**6)) for _ in range(20 * 700 + 100)]
    pairs = {}
    for n in (150, 600):
        docs = spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 100])) for i in range(n)], "doc_id long, text string")
        described = N._own(docs).mapInArrow(N.lean(N._described), "doc_id long, text_hash long, node binary, n_words long, signature binary, bands array<long>")
        sizes = N.buckets(described).selectExpr("explode(spots) s").groupBy("s.code").count().collect()
        pairs[n] = sum(r["count"] * (r["count"] - 1) // 2 for r in sizes)
    assert pairs[600] < 6 * max(pairs[150], 50)
    assert {r["n_links"] for r in N.classes(docs).collect()} == {0}


def test_query(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op1_ngram_join(spark, str(tmp_path)).collect()), key=repr) == brute(corpus())


def test_blocks_of_a_large_bucket_meet(docs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NODES", 50)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in N.classes(docs).collect()), key=repr) == brute(corpus())


def test_components_of_chains_hubs_and_pairs(spark):
    pick = random.Random(6)
    edges = [(f"c{i:04}", f"c{i + 1:04}") for i in range(300)] + [("hub", f"h{i}") for i in range(500)] + [(f"p{i}", f"q{i}") for i in range(50)] + [("s", "s"), ("c0001", "c0000")]
    pick.shuffle(edges)
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {f"c{i:04}": "c0000" for i in range(1, 301)} | {x: "h0" for x in ["hub", *(f"h{i}" for i in range(1, 500))]} | {f"q{i}": f"p{i}" for i in range(50)}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_both_ways_of_verifying_agree():
    random_ = np.random.default_rng(5)
    sets = [np.unique(random_.integers(0, 60, random_.integers(80, 300)).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    many = N.verified(sets, i, j, 0.8)
    one = np.array([N.verified(sets, i[k : k + 1], j[k : k + 1], 0.8)[0] for k in range(len(i))])
    assert (many == one).all() and many.any()
