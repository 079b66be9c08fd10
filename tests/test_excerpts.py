"""Anchors, expansion, merging and budgets: by hand and on random pages."""

from __future__ import annotations

import random

import pytest
from gleaner.config import Anchors, Dedupe, Excerpts, Expand, Extraction
from gleaner.operators import excerpts as X


def page(*specs: tuple[str, str], score: float = 0.5) -> list[X.Sentence]:
    return [X.Sentence(i, t, frozenset(t.split()), kind, [], score, i) for i, (kind, t) in enumerate(specs)]


def chunk(places, score, anchor=None) -> X.Chunk:
    places = list(places)
    return X.Chunk(frozenset(places), places[0] if anchor is None else anchor, score, "t", 10 * len(places))


def test_chunk_text():
    s = page(("h2", "Title"), ("p", "One."), ("p", "Two."), ("pre", "code"), ("p", "After."), ("li", "a"), ("li", "b"), ("h3", "Next"), ("p", "End."))
    assert X.chunk_text(s) == "Title\n\nOne. Two.\n\n```\ncode\n```\n\nAfter.\n\n- a\n- b\n\nNext\n\nEnd."
    assert X.chunk_text(page(("li", "a"), ("p", "b"))) == "- a b"
    assert X.chunk_text(page(("pre", "a"), ("pre", "b"))) == "```\na\n```\n\n```\nb\n```"
    assert X.chunk_text([]) == ""


def test_section_bounds():
    p = X.Page(page(("p", "x"), ("h1", "A"), ("p", "x"), ("h2", "B"), ("p", "x"), ("h3", "C"), ("p", "x"), ("h2", "D"), ("p", "x")))
    assert p.section(0) == (0, 0) and p.section(2) == (1, 8) and p.section(4) == (3, 6) and p.section(6) == (5, 6) and p.section(3) == (3, 6) and p.section(8) == (7, 8)


def test_trim_alternates_and_stops_at_misfits():
    p = X.Page(page(("h1", "H" * 5), ("p", "a" * 10), ("p", "b" * 10), ("p", "c" * 10), ("p", "d" * 40), ("p", "e" * 10)))
    assert p.fitted(3, 200) == (0, 5)
    assert p.fitted(3, 30) == (2, 3)  # b, then d does not fit, then a does not fit
    assert p.fitted(3, 39) == (0, 3)  # used 10, 21, 32; the heading's 5 bring it below 39
    assert p.fitted(4, 20) == (4, 4)


def test_fixed_counts():
    p = X.Page(page(*[("p", "x" * 10)] * 9))
    c = Expand(max_chars=1000, to_section=False, before=2, after=3)
    assert p.around(4, c) == (2, 7) and p.around(0, c) == (0, 3)
    assert p.around(4, Expand(max_chars=35, to_section=False, before=2, after=3)) == (4, 6)


def test_code_may_overrun():
    p = X.Page(page(("p", "a" * 20), ("pre", "c" * 100), ("p", "b")))
    assert p.with_code(0, 0, 80) == 1 and p.with_code(0, 0, 79) == 0
    q = X.Page(page(("p", "a" * 20), ("p", "b" * 20), ("h2", "H"), ("pre", "c")))
    assert q.with_code(0, 0, 40) == 1 and q.with_code(0, 0, 39) == 0


def test_expanded_chunk_counts_raw_characters():
    p = X.Page(page(("h2", "Title"), ("p", "One😀"), ("pre", "code")))
    got = p.chunk(p.all[1], Expand(), 1)
    assert got.chars == 5 + 5 + 4 and got.text.startswith("Title\n\nOne")
    assert p.chunk(p.all[1], Expand(), 9).text == ""


def test_anchors():
    s = [X.Sentence(i, "", frozenset(t.split()), "p", [], v, i) for i, (t, v) in enumerate([("a b c", 0.9), ("d e f", 0.8), ("a b d", 0.7), ("x y", 0.3), ("z", 0.2)])]
    ranked = sorted(s, key=lambda x: -x.score)
    assert [x.pos for x in X.choose_anchors(ranked, Anchors(5, 0.25, 0.4, None))] == [0, 1, 3]
    assert [x.pos for x in X.choose_anchors(ranked, Anchors(5, 0.25, 0.5, None))] == [0, 1, 2, 3]
    assert [x.pos for x in X.choose_anchors(ranked, Anchors(5, 0.25, 1.0, 2))] == [0, 2]
    assert [x.pos for x in X.choose_anchors(ranked, Anchors(1, 0.25, 0.4, None))] == [0]


def test_merging():
    p = X.Page(page(*[("p", f"w{i}") for i in range(12)]))
    merged = X.merge_chunks(p, [chunk(range(4), 0.9), chunk(range(2, 6), 0.5)], Dedupe(0.5, 1.1))
    assert [sorted(c.places) for c in merged] == [list(range(6))] and merged[0].anchor == 0 and merged[0].chars == len(merged[0].text)
    chain = X.merge_chunks(p, [chunk(range(3), 0.9), chunk(range(2, 5), 0.8), chunk(range(4, 7), 0.7)], Dedupe(0.3, 1.1))
    assert [sorted(c.places) for c in chain] == [list(range(7))]
    apart = X.merge_chunks(p, [chunk(range(3), 0.9), chunk(range(6, 9), 0.8)], Dedupe(0.3, 0.6))
    assert len(apart) == 2


@pytest.mark.parametrize("threshold, kept", [(0.72, 2), (0.6, 1), (0.5, 1)])
def test_same_words_go(threshold, kept):
    p = X.Page([X.Sentence(i, t, frozenset(t.split()), "p", [], 0.5, i) for i, t in enumerate(["a b c d", "a b c e"])])
    assert len(X.merge_chunks(p, [chunk([0], 0.9), chunk([1], 0.8)], Dedupe(0.5, threshold))) == kept


def test_contained_chunks_go():
    got = X.drop_contained([chunk([1, 2], 0.9), chunk([0, 1, 2, 3], 0.5), chunk([3, 4], 0.4), chunk([], 0.3, 0)])
    assert [sorted(c.places) for c in got] == [[0, 1, 2, 3], [3, 4]]


def test_budget_passes_over():
    chunks = [X.Chunk(frozenset([i]), i, s, "", n) for i, (s, n) in enumerate([(0.9, 500), (0.8, 600), (0.7, 90), (0.6, 400), (0.5, 100)])]
    assert [c.anchor for c in X.within_budget(chunks, Excerpts(5, 1000, 100))] == [0, 3, 4]
    assert [c.anchor for c in X.within_budget(chunks, Excerpts(2, 1000, 100))] == [0, 3]


def test_opening():
    s = [("a" * 50, [], 0.0), ("b" * 50, [], 0.1), ("c" * 10, [], 0.2), ("d", [], 0.5)]
    c = Extraction(excerpts=Excerpts(3, 60, 100))
    assert [x[0][0] for x in X.opening_excerpts(s, c)] == ["a"]  # stops at the first that does not fit
    assert [x[0][0] for x in X.opening_excerpts(s, Extraction(excerpts=Excerpts(2, 6000, 100)))] == ["a", "b"]


def slow_section(sizes, kinds, at, most):
    """Expansion told step by step over one page."""
    start, level = at, 6
    for i in range(at, -1, -1):
        if kinds[i][0] == "h":
            start, level = i, int(kinds[i][1])
            break
    end = at
    while end + 1 < len(kinds) and not (kinds[end + 1][0] == "h" and int(kinds[end + 1][1]) <= level):
        end += 1
    if sum(sizes[start : end + 1]) + (end - start + 1) <= most:
        return start, end
    a = b = at
    used, front, back = sizes[at], at > start, at < end
    while (front or back) and used < most:
        if front:
            if used + sizes[a - 1] < most:
                a -= 1
                used += sizes[a] + 1
                front = a > start
            else:
                front = False
        if back and used < most:
            if used + sizes[b + 1] < most:
                b += 1
                used += sizes[b] + 1
                back = b < end
            else:
                back = False
    return a, b


@pytest.mark.parametrize("seed", range(60))
def test_random_expansion(seed):
    pick = random.Random(seed)
    specs = [(pick.choice(["p", "p", "p", "li", "pre", "h1", "h2", "h3"]), "x" * pick.randint(1, 60)) for _ in range(pick.randint(1, 30))]
    s = page(*specs)
    p = X.Page(s)
    for at in range(len(s)):
        for most in (20, 60, 150, 400):
            assert p.fitted(at, most) == slow_section([len(t) for _, t in specs], [k for k, _ in specs], at, most)


def test_adapted_chunks_aim_at_a_size_of_their_own():
    p = X.Page(page(*[("p", "x" * 100)] * 40))
    usual, wide, narrow = p.chunk(p.all[20], X.Expand(), 20), p.adapted(p.all[20], X.Expand(), 20), p.adapted(p.all[20], X.Expand(), 20, 300)
    assert narrow.chars <= 300 < wide.chars <= 1500 < usual.chars
