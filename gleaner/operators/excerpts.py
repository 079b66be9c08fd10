"""From ranked sentences to excerpts: anchors, sections, merging, budget.

These steps are sequential by nature: each choice depends on the ones before. A
group is one page and one query, so a task holds one page's sentences at a time;
groups arrive sorted and are streamed through Arrow.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Anchors, Dedupe, Excerpts, Expand, Extraction
from ..session import ship

CODE_SLACK = 1.5


@dataclass
class Sentence:
    pos: int
    text: str
    tokens: frozenset[str]
    type: str
    path: list[str]
    score: float
    index: int = 0

    @property
    def level(self) -> int:
        """1-6 for headings, 7 for all else."""
        return int(self.type[1]) if len(self.type) == 2 and self.type[0] == "h" and self.type[1] in "123456" else 7

    @property
    def size(self) -> int:
        return units(self.text)


@dataclass
class Chunk:
    places: frozenset[int]
    anchor: int
    score: float
    text: str
    chars: int
    path: list[str] = field(default_factory=list)

    @property
    def order(self) -> tuple[float, int]:
        return -self.score, self.anchor


def units(text: str) -> int:
    """UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text)


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def choose_anchors(ranked: list[Sentence], c: Anchors) -> list[Sentence]:
    """The best sentences that are neither alike nor close to a better one."""
    chosen: list[Sentence] = []
    for s in ranked:
        if len(chosen) == c.max_anchors:
            break
        far = all(c.min_gap is None or abs(s.index - a.index) >= c.min_gap for a in chosen)
        if s.score >= c.min_score and far and all(jaccard(s.tokens, a.tokens) <= c.diversity for a in chosen):
            chosen.append(s)
    return chosen


class Page:
    """One page's sentences with running sizes and headings, for expansion."""

    def __init__(self, sentences: list[Sentence]):
        self.all = sentences
        self.sizes = [s.size for s in sentences]
        self.ends = list(accumulate(self.sizes, initial=0))
        self.headings = [i for i, s in enumerate(sentences) if s.level < 7]

    def chars(self, a: int, b: int) -> int:
        return self.ends[b + 1] - self.ends[a]

    def section(self, at: int) -> tuple[int, int]:
        """From the heading at or before ``at`` to before the next of its level or above."""
        k = bisect_right(self.headings, at)
        start = self.headings[k - 1] if k else at
        level = self.all[start].level if k else 6
        end = next((i - 1 for i in self.headings[k:] if self.all[i].level <= level), len(self.all) - 1)
        return start, end

    def fitted(self, at: int, most: int) -> tuple[int, int]:
        """The section, or what fits of it around ``at``, sides taking turns."""
        start, end = self.section(at)
        if self.chars(start, end) + end - start + 1 <= most:
            return start, end
        a = b = at
        used = self.sizes[at]
        sides = [s for s, open_ in (("before", a > start), ("after", b < end)) if open_]
        while sides and used < most:
            for side in list(sides):
                if used >= most and side == "after":
                    break
                following = a - 1 if side == "before" else b + 1
                if used + self.sizes[following] >= most:
                    sides.remove(side)
                    continue
                used += self.sizes[following] + 1
                a, b = min(a, following), max(b, following)
                if side == "before" and a <= start or side == "after" and b >= end:
                    sides.remove(side)
        return a, b

    def around(self, at: int, c: Expand) -> tuple[int, int]:
        """A fixed count of neighbours, shortened in front, then behind."""
        a, b = max(0, at - c.before), min(len(self.all) - 1, at + c.after)
        while self.chars(a, b) > c.max_chars and a < at:
            a += 1
        while self.chars(a, b) > c.max_chars and b > at:
            b -= 1
        return a, b

    def with_code(self, a: int, b: int, most: int) -> int:
        """The end after following sentences that fit, up to the first code block,
        which may overrun by half."""
        used = self.chars(a, b)
        for i in range(b + 1, len(self.all)):
            code = self.all[i].type == "pre"
            if self.all[i].level < 7 or used + self.sizes[i] > most * (CODE_SLACK if code else 1):
                break
            b, used = i, used + self.sizes[i]
            if code:
                break
        return b

    def chunk(self, anchor: Sentence, c: Expand, at: int) -> Chunk:
        if not 0 <= at < len(self.all):
            return Chunk(frozenset(), anchor.index, anchor.score, "", 0, anchor.path)
        a, b = self.fitted(at, c.max_chars) if c.to_section else self.around(at, c)
        if c.include_code:
            b = self.with_code(a, b, c.max_chars)
        return Chunk(frozenset(range(a, b + 1)), anchor.index, anchor.score, chunk_text(self.all[a : b + 1]), self.chars(a, b), anchor.path)

    def adapted(self, anchor: Sentence, c: Expand, at: int, target: int = 1500) -> Chunk:
        """A chunk that aims at ``target`` characters, whatever the usual limit."""
        return self.chunk(anchor, replace(c, max_chars=target), at)

    def merged(self, a: Chunk, b: Chunk) -> Chunk:
        first = a if a.score >= b.score else b
        places = a.places | b.places
        text = chunk_text([self.all[i] for i in sorted(places)])
        return Chunk(places, first.anchor, first.score, text, units(text), first.path)

    def words(self, c: Chunk) -> frozenset[str]:
        return frozenset().union(*(self.all[i].tokens for i in c.places))


def chunk_text(sentences: list[Sentence]) -> str:
    """Headings apart, code fenced, items as a list, the rest as running text."""
    out, before = "", None
    for s in sentences:
        if s.type == "pre":
            out += f"\n\n```\n{s.text}\n```"
        elif s.type == "li":
            out += ("" if before is not None and before.type == "li" else "\n") + f"\n- {s.text}"
        elif before is None:
            out += s.text
        elif s.level < 7 or before.type == "pre" or before.level < 7:
            out += f"\n\n{s.text}"
        else:
            out += f" {s.text}"
        before = s
    return out.strip()


def merge_chunks(page: Page, chunks: list[Chunk], c: Dedupe) -> list[Chunk]:
    """Best first, each takes in what overlaps it and drops what says the same."""
    rest, out = sorted(chunks, key=lambda x: x.order), []
    while rest:
        best, others = rest[0], rest[1:]
        rest = []
        for other in others:
            smaller = min(len(best.places), len(other.places))
            if smaller and len(best.places & other.places) / smaller >= c.overlap:
                best = page.merged(best, other)
            elif jaccard(page.words(best), page.words(other)) < c.similarity:
                rest.append(other)
        out.append(best)
    return sorted(out, key=lambda x: x.order)


def drop_contained(chunks: list[Chunk]) -> list[Chunk]:
    if len(chunks) < 2:
        return chunks
    kept: list[Chunk] = []
    for x in sorted(chunks, key=lambda x: (-len(x.places), x.anchor)):
        if not any(x.places <= y.places for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x.order)


def within_budget(chunks: list[Chunk], c: Excerpts) -> list[Chunk]:
    """Best first; what is too small or does not fit is passed over."""
    out, used = [], 0
    for x in sorted(chunks, key=lambda x: x.order):
        if len(out) < c.max_excerpts and x.chars >= c.min_chars and used + x.chars <= c.char_budget:
            out.append(x)
            used += x.chars
    return out


def page_excerpts(sentences: list[Sentence], c: Extraction) -> list[Chunk]:
    page = Page(sentences)
    ranked = sorted(sentences, key=lambda s: (-s.score, s.index))
    chunks = [page.chunk(a, c.expand, a.index if c.compat_offsets else a.pos) for a in choose_anchors(ranked, c.anchors)]
    return within_budget(drop_contained(merge_chunks(page, chunks, c.dedupe)), c.excerpts)


def opening_excerpts(sentences: list[tuple[str, list[str], float]], c: Extraction) -> list[tuple[str, list[str], float]]:
    """Without a query: the first sentences of the page, until one does not fit."""
    early = [s for s in sentences if s[2] < 0.4][: c.anchors.max_anchors]
    sizes = list(accumulate(units(s[0]) for s in early))
    return [s for s, used in zip(early, sizes) if used <= c.excerpts.char_budget][: c.excerpts.max_excerpts]


def streamed(rows: DataFrame, keys: list[str], order: list[str], make, schema: str) -> DataFrame:
    """``make(list of row dicts) -> list of row tuples`` for each group of ``rows``:
    one shuffle by key, groups sorted and streamed, one held at a time."""
    ship(rows.sparkSession)
    names = [x.name for x in rows.limit(0).selectExpr(*keys).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None
        out: list[tuple] = []
        kinds = None
        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            for row in batch.to_pylist():
                now = tuple(row[k] for k in names)
                if now != key and held:
                    out += [key + t for t in make(held)]
                    held = []
                    if len(out) >= 2000:
                        yield _batch(out, names, kinds, schema)
                        out = []
                key = now
                held.append(row)
        if held:
            out += [key + t for t in make(held)]
        if out:
            yield _batch(out, names, kinds, schema)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{kinds}, {schema}")


def _batch(rows: list[tuple], names: list[str], kinds: dict, schema: str) -> pa.RecordBatch:
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    own = [x.rsplit(" ", 1) for x in schema.split(", ")]
    columns = list(zip(*rows))
    types = [kinds[k] for k in names] + [arrow[t] for _, t in own]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names + [n for n, _ in own])


EXCERPT = "excerpt int, text string, heading_path array<string>, score double, char_count int, anchor int, places array<int>"


def _sentences(rows: list[dict]) -> list[Sentence]:
    return [Sentence(i, r["text"], frozenset(r["tokens"]), r["block_type"], r["heading_path"], r["combined_score"], r["global_index"] if "global_index" in r else i) for i, r in enumerate(rows)]


def excerpts(scored: DataFrame, c: Extraction, keys: tuple[str, ...] = ("query_id", "page_id")) -> DataFrame:
    """The excerpts of every group of scored sentences, best first."""

    def make(rows: list[dict]) -> list[tuple]:
        found = page_excerpts(_sentences(rows), c)
        return [(i, x.text, x.path, x.score, x.chars, x.anchor, sorted(x.places)) for i, x in enumerate(found)]

    wanted = scored.select(*keys, "global_index", "text", "tokens", "block_type", "heading_path", "combined_score")
    return streamed(wanted, list(keys), ["global_index"], make, EXCERPT)


def opening(sentences: DataFrame, c: Extraction, keys: tuple[str, ...] = ("query_id", "page_id")) -> DataFrame:
    """Excerpts for queries without tokens."""

    def make(rows: list[dict]) -> list[tuple]:
        found = opening_excerpts([(r["text"], r["heading_path"], r["position"]) for r in rows], c)
        return [(i, t, p, 1 - at, units(t), i, []) for i, (t, p, at) in enumerate(found)]

    wanted = sentences.select(*keys, "global_index", "text", "heading_path", "position").where(F.col("position") < 0.4)
    return streamed(wanted, list(keys), ["global_index"], make, EXCERPT)
