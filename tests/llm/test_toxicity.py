"""The toxicity grammar, what is learned, and held-out accuracy."""

from __future__ import annotations

import random
import zlib

import pytest
from gleaner.llm import toxicity as T

INSULTS = ["blorg", "snarf", "grimp"]
PLAIN = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]


def test_clauses_are_scored_in_context():
    model = T.Model({"blorg ": 3.0, "snar": 2.0})

    def score(text: str) -> float:
        return sum(model.clauses(text))

    assert score("a blorg came") == 3.0
    assert score("you blorg") > score("a blorg came") > score("not a blorg") > 0
    assert score("she said that a blorg came") == 2.0
    assert score("blorgs came, ablorg too") == 0
    assert score("Snarfing, SNARF.") > 2.0
    assert len(model.clauses("a blorg. a blorg; nothing\nblorg")) == 3
    assert score("blorg, I will kill you") > score("blorg, I will see you")
    assert T.Model().clauses("blorg") == [] and model.features(None) == model.features("")


def test_threats_score_without_an_insult():
    for model in (T.Model(), T.Model({"blorg ": 3.0})):
        for text in ("I will kill you", "we burn your house", "il va tuer ton chien", "sie vernichten dich", "va a matar a usted"):
            assert model.clauses(text) == [2.0], text
        assert model.clauses("a plain line. I will kill you; nothing\nwe burn your house") == [2.0, 2.0]
        assert model.clauses("they kill time") == model.clauses("he will not kill you") == model.clauses("the skill you have") == []
    assert T.Model({"blorg ": 3.0}).clauses("a blorg came. I will kill you") == [3.0, 2.0]
    assert T.Model(weights=[-3.0, 4.0, 0.0, 0.0, 0.0]).score("I will kill you") > 0.5


def test_composition_is_the_product():
    following, events = T.GRAMMAR
    assert len(following) == 2 * 5 * 5 * 4 * 2
    assert events[following[0][T.NEGATION]][T.INSULT] == (T.NEGATED,)
    assert T.Model().added[following[0][T.NEGATION]][T.INSULT] == -2.0


def test_event_weights_are_learned():
    """Reported insults that are as toxic as others lose the lowering; where they are
    clean, it stays. Priors alone would not tell the two cases apart."""
    pick = random.Random(4)
    found = {}
    for reported_is_toxic in (False, True):
        model, rows, y = T.Model({"blorg ": 3.0}), [], []
        for i in range(900):
            kind = i % 3
            rows.append(model.emitted(" ".join(pick.choices(PLAIN, k=20)) + ["", ". a blorg came", ". she said that a blorg came"][kind]))
            y.append(float(kind == 1 or kind == 2 and reported_is_toxic))
        x = T.np.array(rows)
        learned = T.learn_events(x, T.np.array(y), T.np.ones(len(y)))
        assert learned[T.THREATENED] >= 1.0
        found[reported_is_toxic] = learned[T.REPORTED]
    assert found[False] < T.PRIOR[T.REPORTED] < found[True]


def test_repeated_ids_and_very_long_texts(spark):
    """Every row is scored; of a labelled id's texts one is learned from."""
    docs = spark.createDataFrame([(i % 40, f"{'blorg' if i % 4 == 0 else 'word'} text {i % 40}") for i in range(4000)] + [(41, "plain " * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    rows = T.score_documents(docs, labels).collect()
    assert len(rows) == 4001 and len({(r["doc_id"], r["score"]) for r in rows}) == 41


@pytest.fixture(scope="module")
def corpus(spark):
    pick = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = pick.choices(PLAIN, k=pick.randint(5, 120))
        if toxic:
            for _ in range(pick.randint(1, 4)):
                words.insert(pick.randint(0, len(words)), pick.choice(INSULTS))
        docs.append((i, " ".join(words), 0.5))
        if i % 3:
            labels.append((i, int(toxic), 1))
    docs += [(None, None, 0.1), (7, docs[7][1], 0.2), (9001, "", 0.3), (9002, "plain " * 50_000, 0.3)]
    labels += [(None, 1, 1), (1, None, 1), (5, 0, 0), (5, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out(corpus):
    docs, labels = corpus
    rows = T.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)


def test_rare_insults_are_learned_beside_many_frequent_words(spark):
    pick = random.Random(3)
    common = " ".join("".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(4_500))
    assert len(T.entries(common)) > 20_000
    docs, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        docs.append((i, common + " blorg" * (toxic and i % 16 == 0)))
        labels.append((i, int(toxic)))
    model = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {e.strip() for e in model.lexicon} & {"blor", "blorg"}


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", T.F.when(T.fold(T.F.col("doc_id")) == 0, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, flipped)
    assert a.lexicon == b.lexicon and a.weights == b.weights


def test_no_labels_and_no_documents(corpus):
    docs, labels = corpus
    assert {r["predicted"] for r in T.score_documents(docs, labels.limit(0)).collect()} == {0}
    assert T.score_documents(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in T.score_documents(docs, labels.where("toxic = 1")).collect()} <= {1}
