"""Settings of extraction and search, as frozen records with presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Tokens:
    stop_words: bool = True  # leave them out
    min_length: int = 2


@dataclass(frozen=True)
class Ranker:
    bm25_weight: float = 0.6
    heuristic_weight: float = 0.4
    mode: str = "strict"  # or "search", which asks for less
    weights: dict[str, float] = field(default_factory=dict)  # of heuristics by name, where others than usual


@dataclass(frozen=True)
class Anchors:
    max_anchors: int = 5
    min_score: float = 0.25
    diversity: float = 0.4
    min_gap: int | None = 5


@dataclass(frozen=True)
class Expand:
    max_chars: int = 2000
    include_code: bool = True
    to_section: bool = True
    before: int = 5
    after: int = 8


@dataclass(frozen=True)
class Dedupe:
    overlap: float = 0.3
    similarity: float = 0.6


@dataclass(frozen=True)
class Excerpts:
    max_excerpts: int = 3
    char_budget: int = 6000
    min_chars: int = 100


@dataclass(frozen=True)
class Quality:
    min_sentences: int = 5
    min_long: int = 3
    max_fragments: float = 0.65
    min_median: float = 25


@dataclass(frozen=True)
class Extraction:
    tokens: Tokens = field(default_factory=Tokens)
    bm25: Bm25 = field(default_factory=Bm25)
    ranker: Ranker = field(default_factory=Ranker)
    anchors: Anchors = field(default_factory=Anchors)
    expand: Expand = field(default_factory=Expand)
    dedupe: Dedupe = field(default_factory=Dedupe)
    excerpts: Excerpts = field(default_factory=Excerpts)
    quality: Quality = field(default_factory=Quality)
    skip_quality: bool = False
    stem: bool = True
    sql: bool = False  # sentences, tokens and citations as SQL has them, see functions.text
    compat_offsets: bool = False  # index by the number before citations went

    def merged(self, **sections: dict | bool) -> Extraction:
        """A copy; a section given as a dict changes only the named fields."""
        return replace(self, **{k: replace(getattr(self, k), **v) if isinstance(v, dict) else v for k, v in sections.items()})


DEFAULT = Extraction()
SEARCH = DEFAULT.merged(ranker={"mode": "search"}, expand={"before": 8, "after": 12}, excerpts={"max_excerpts": 5, "char_budget": 3000})
FETCH = DEFAULT.merged(ranker={"mode": "search"}, anchors={"max_anchors": 10}, expand={"max_chars": 3000, "before": 10, "after": 15}, excerpts={"max_excerpts": 15, "char_budget": 12000})
FILE = DEFAULT.merged(excerpts={"char_budget": 4000})


@dataclass(frozen=True)
class Search:
    max_results: int = 5
    per_page_chars: int = 3000
    total_chars: int = 12000
    over_fetch: int = 2
    min_title_match: float = 0.4
    session_seconds: int = 10
    extraction: Extraction = SEARCH
