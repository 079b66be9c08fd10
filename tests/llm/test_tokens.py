"""The BPE automaton, its documents' digests and packing, against the library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from gleaner.llm import packing, queries, tokens
from gleaner.llm.bpe import Automaton, Encoder

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "tion", " ", "  ", "'", "'s", "'ll", "'S", "\n", "\t", "\x85", "\xa0", "é", "中", "1", "²", "!", "😀", "<|endoftext|>", "\x1c", "aaaa", "\U0010ffff", "_", "...", "----", "​"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def samples(n: int) -> list[str]:
    pick = random.Random(3)
    return ["".join(pick.choices(PARTS, k=pick.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_library(library):
    own = Encoder(PATH)
    texts = [*samples(3000), "", "x" * 3000, "ab " * 400_000, "\n" * 5000, " " * 3000 + "end"]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert own.automaton.decode(ids.tolist()).decode() == text


def test_documents(spark, library):
    rows = [(1, None, 5), (2, "", 6), (3, "hello world's end", 7), (3, "hello world's end", 7), (None, "the " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = tokens.decode_documents(tokens.encode_documents(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["decoded"]) for r in back) == sorted((i or 0, t or "", t or "") for i, t, _ in rows)
    assert all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in back)
    assert tokens.round_trip_digests(docs, PATH).count() == 5
    assert tokens.round_trip_digests(docs.limit(0), PATH).count() == 0


def check_packing(rows, texts: dict, window: int, library) -> int:
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing(spark, library):
    pick = random.Random(5)
    texts = {i: " ".join(pick.choices(["the", "of", "token", "zqx"], k=pick.randint(0, 300))) for i in range(400)} | {1000: None, 1001: "word " * 20_000, 1002: "", None: "no id"}
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, part long").repartition(2)
    # only the last sequence of the table is short, whatever the window
    assert check_packing(packing.pack_documents(docs, PATH, window=256).collect(), texts, 256, library) <= 256
    assert check_packing(packing.pack_documents(docs, PATH).collect(), texts, 2048, library) <= 2048
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("parts", [2, 64])
def test_fill_does_not_depend_on_partitions(spark, parts):
    pick = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(pick.choices(["the", "of", "token"], k=pick.randint(0, 1500)))) for i in range(400)], "doc_id long, text string").repartition(parts)
    rows = packing.pack_documents(docs, PATH).collect()
    assert sum(r["length"] for r in rows) >= 0.98 * 2048 * len({r["sequence_id"] for r in rows})


def test_packing_of_repeated_and_equal_rows(spark, library):
    rows = [(7, "the same text " * 90)] * 30 + [(None, "the same text " * 90)] * 3
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, window=256).collect()
    ids = np.array([*library.encode(rows[0][1], add_special_tokens=False).ids, 1], "<u4")
    sequences = defaultdict(list)
    for r in pieces:
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in pieces) == 33 * len(ids)
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [sum(n for o2, n in own if o2 < o) for o, _ in sorted(own)]


def test_combinations_decide_the_plan():
    histogram = {100: 50, 156: 50, 56: 20, 200: 20, 13: 5}
    made = packing.plan(histogram, 256)
    # complementary lengths meet in one sequence at the offsets that the combination says
    assert made.places(156, 0) == [(0, 156, made.slots[156][0][1], 0)] and made.places(100, 0)[0][2:] == (made.slots[100][0][1], 156)
    assert made.line[156][0] == 50 and made.line[100][0] == 50 and made.line[200][0] == 20
    assert made.line[13] == (0, 0)


def digests(texts, library):
    out = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip_query(spark, library, tmp_path):
    rows = [(i, t, i) for i, t in enumerate(samples(300))] + [(5, None, 0), (5, "", 0), (None, "x" * 9000 + "<|endoftext|> y", 1), (6, "a b", 2), (6, "a b", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_bpe(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == digests([r[:2] for r in rows], library)


def test_words_that_share_a_hash_are_told_apart(library):
    own = Encoder(PATH)
    own._find = lambda hashes: np.where(own.slot_word[:1] >= 0, 0, -1).repeat(len(hashes)) if own.n_words else np.full(len(hashes), -1)
    own._hashes = lambda which, codes, starts, ends: np.zeros(len(starts), np.uint64) if which == 0 else Encoder._hashes(own, which, codes, starts, ends)
    for text in ("alpha beta gamma", "beta delta alpha", "delta"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_table_begins_anew_within_a_word(library):
    own = Encoder(PATH)
    own.automaton.MEMO = 20
    for text in ("internationalization" * 40, "x" * 3000, "Donaudampfschifffahrt" * 9):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_new_words_are_encoded_together(library, monkeypatch):
    own = Encoder(PATH)
    monkeypatch.setattr(own.automaton, "encode_word", lambda word: pytest.fail("a step of the interpreter for each byte of each new word"))
    pick = random.Random(5)
    texts = [" ".join("".join(pick.choices("abdeinorstué中😀'1", k=pick.randint(1, 40))) for _ in range(400)) for _ in range(8)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables_of_batches_begin_anew(library, monkeypatch):
    monkeypatch.setattr(Automaton, "SLOTS", 512)
    own = Encoder(PATH)
    own.automaton.MEMO, own.automaton.BYTES = 100, 64
    begun, forget = [], own.automaton._forget
    monkeypatch.setattr(own.automaton, "_forget", lambda: (begun.append(own.automaton.n_steps), forget()))
    texts = samples(300)
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(begun) > 10 and max(begun) <= 512 // 2 + 64


def test_least_squares_matches_histogram():
    wanted = np.zeros(11, np.int64)
    wanted[[3, 7, 5, 2]] = [40, 40, 20, 10]
    lengths = np.flatnonzero(wanted)
    combos = packing.combinations(lengths, wanted[lengths], 10)
    solved = dict(zip(combos, packing.nnls(combos, wanted, 200)))
    assert min(solved.values()) >= 0
    made = sum(np.bincount(c, minlength=11) * x for c, x in solved.items())
    assert np.abs(made - wanted).max() < 7
