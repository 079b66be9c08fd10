"""The registered queries themselves on odd tables: against their SQL, or brute force."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from gleaner.llm import queries

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")
LINE = "a line of more than forty characters that many documents share"


def documents() -> list[tuple]:
    pick = random.Random(21)
    words = [f"w{i}" for i in range(400)] + ["é\xa0x", "中", "#", "|"]
    passage = " ".join(pick.choices(words, k=130))
    rows = []
    for i in range(80):
        text = " ".join(pick.choices(words, k=pick.choice([0, 1, 4, 5, 40, 90])))
        if i % 4 == 0:
            text += f"\n  {LINE.upper() if i % 8 else LINE}\t\n{text}"
        if i % 5 == 0:
            text = f"{text} {passage[i % 7 :]} {i}"
        rows.append((i, text, pick.choice(["en", None]), f"s{i % 3}" if i % 11 else None, len(text)))
    copy = rows[10][1]
    rows += [(100 + k, copy + (" x" if k == 3 else ""), "en", "s0", 1) for k in range(4)] + [(200, None, None, "s1", None), (201, "", None, None, 0), (202, " \n ", "en", "s1", 3)]
    return rows + [(300, "long " * 30_000 + LINE, "en", "s2", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with columns whose names the operators use themselves."""
    at = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, __doc string, words int"
    rows = [(*r, "n", "d", 1) for r in documents()]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(i, f"http://x/{i}", [None, "", "<p>a", "é" * 50][i % 4], "s") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string, sha string").write.parquet(f"{at}/pages.parquet")
    numbers = np.random.default_rng(2).standard_normal((300, 8))
    numbers[7], numbers[8], numbers[9] = numbers[50], 1e-200 * numbers[50], 1e200 * numbers[100]
    spark.createDataFrame([(i, v.tolist(), "r") for i, v in enumerate(numbers)] + [(500, None, "r"), (550, [0.0] * 8, "r")], "vec_id long, embedding array<double>, row string").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["op1_ngram_join", "op5_line_dedup", "op6_host_rules", "op7_warc", "op10_suffix_dedup"])
def test_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    plain = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(plain, key=repr)


def test_nearest(spark, folder):
    table = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] and any(r["embedding"])}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in table.items()}
    found = defaultdict(list)
    for r in queries.op2_nearest(spark, folder).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {i for i in table if i % 50 == 0}
    for q, near in found.items():
        best = sorted((-float(unit[q] @ v), i) for i, v in unit.items() if i != q)[:5]
        assert [i for i, _ in near] == [i for _, i in best] or np.allclose([s for _, s in near], [-s for s, _ in best], atol=1e-12)
        assert np.allclose([s for _, s in near], [-s for s, _ in best], atol=1e-12)


def test_toxicity(spark, folder):
    rows = queries.op4_toxicity(spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in documents())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_packing(spark, folder):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op8_packing(spark, folder).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {r[0] for r in documents()}
    for own in pieces.values():
        own.sort()
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
