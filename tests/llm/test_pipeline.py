"""The corpus pipeline against stage-wise plain Python on planted cases."""

from __future__ import annotations

import random
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402
from gleaner.llm.bpe import Encoder  # noqa: E402
from gleaner.llm.queries import vocabulary  # noqa: E402

LINE = "A boilerplate line of more than forty characters, everywhere."
SECRET = "password = hunter2hunter2"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pick = random.Random(9)
    words = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    docs, labels = [], []
    for i in range(400):
        text = " ".join(pick.choices(words, k=120))
        if i % 5 == 0:
            text += " blorg snarf blorg"
        if i % 7 == 0:
            text = f"{LINE}\n{text}"
        if i % 11 == 0:
            text = f"{text}\n{SECRET} end"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    copy = docs[1][1]
    docs += [(1000, copy, "en", "s1", len(copy)), (1001, copy + " tail", "en", None, len(copy) + 5), (1002, None, None, None, None), (1003, "", "en", "s1", 0)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, str(folder)


def test_stages(spark, corpus):
    docs, folder = corpus
    now = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {}
    for name, stage in P.STAGES[:-1]:
        now = P.materialize(stage(spark, now, folder), name)
        assert now.columns == P.COLUMNS
        rows = now.collect()
        texts[name] = {r["doc_id"]: r["text"] for r in rows}
        assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)
    raw = {d[0]: d[1] for d in docs}
    clean = {i for i in raw if i >= 400 or i % 5}
    assert texts["toxicity"] == {i: raw[i] for i in clean}
    keeper = max(i for i in clean if i < 400 and i % 7 == 0)
    lined = {i: t.replace(LINE + "\n", "") if t and i != keeper else t for i, t in texts["toxicity"].items()}
    assert texts["line_dedup"] == lined
    assert texts["ngram_join"] == {i: t for i, t in lined.items() if i not in (1000, 1001, 1003)}
    assert texts["secret_scan"] == {i: t and re.sub(SECRET, "[SECRET]", t) for i, t in texts["ngram_join"].items()}
    pieces = P.run(spark, folder).collect()
    encoder = Encoder(vocabulary())
    sizes = {i: len(x) + 1 for i, x in zip(texts["secret_scan"], encoder.encode(list(texts["secret_scan"].values())))}
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == sizes
    assert sum(r["length"] for r in pieces) == sum(sizes.values())


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids and texts, a very long text, repeated rows, extra columns: all that is
    neither toxic nor a copy is packed whole."""
    long = " ".join(f"word{i % 977}{i % 1009}" for i in range(60_000))
    rows = [(None, "a text without id and with several words", "en", "s", 1, "x"), (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, long, "en", "s", 1, "x")]
    rows += [(4, "the very same row " * 9, "en", "s", 1, "x")] * 3 + [(5, "other words of a fifth document here", "en", "s", 1, "x")]
    for name, held in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(held, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(9, 1, 0)] if held else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found = P.run(spark, folder).collect()
        sizes = {r["doc_id"]: r["doc_tokens"] for r in found}
        assert set(sizes) == ({None, 1, 3, 4, 5} if held else set())
        assert sum(r["length"] for r in found) == sum(sizes.values())
