"""Toxicity by a weighted finite-state grammar over clauses.

Lexicon: words and word beginnings whose document frequency among toxic labels
is beyond chance (Chernoff bound on the binomial tail) get log-odds weights.
Grammar: five small transducers over token classes (insult, threat, target,
negation, reported speech) are composed into one table of arcs; each arc names the
events it is part of (insult after a target, target after an insult, threat against
a target, negated, reported). Running a clause through it sums the weights of its
matches, each raised or lowered by its events. A word alone does not score: the
clause does. Event weights start from ``PRIOR`` and are moved by a ridge logistic
regression on the labelled sample; document scores come from a logistic model of
clause scores. The function words of the grammar are fixed lists.

Labels are learned from a bounded, hash-ordered sample (``TOXIC_ROWS`` and
``CLEAN_ROWS`` documents) outside the held-out fold; only the word statistics and
features of those, never texts, reach the driver. Every document is then scored
over its whole text in one pass without shuffle, a bounded slice of rows at a time.
Labels, language, source and ids are no inputs of a score.

Defined cases: null or empty text has no clauses and scores by the intercept; a very
long text is scored whole; a null doc_id is not held out; several labels for one id
count as their largest; of several texts of a labelled id the least is learned from;
with no label of one kind the score is the smoothed share of toxic labels; an empty
table gives no rows; other columns pass, and ``score`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import Batches, lean, slices

TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
HELD = 500_000  # entries a task counts before it hands the sums on
PREFIXES = range(3, 9)
EVIDENCE = 16.0  # nats of the tail bound: about 1e-7 by chance
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[^.!?;:\n]+")

INSULT, THREAT, TARGET, NEGATION, REPORT, REST = range(6)
#: Function words of the grammar, by language: English, French, German, Spanish.
WORDS = {
    THREAT: "kill hurt destroy die crush beat burn shoot tuer frapper brûler mourir töten schlagen sterben vernichten matar golpear quemar morir",
    TARGET: "you your you're yourself u tu toi vous ton ta du dich dein ihr euch tú usted ustedes eres",
    NEGATION: "not never no isn't aren't wasn't don't ne pas jamais nicht kein keine nie nunca jamás",
    REPORT: "said says called calls wrote writes quoted claims reported according dit appelé écrit selon sagte sagt nannte schrieb laut dijo dice llamó escribió según",
}
CLASS_OF = {w: kind for kind, words in WORDS.items() for w in words.split()}


#: events of the grammar, with the weight each adds to a match before labels are seen
EVENTS = ("insult after target", "target or insult after insult", "target after threat", "negated", "reported")
AFTER_TARGET, AFTER_INSULT, THREATENED, NEGATED, REPORTED = range(5)
PRIOR = (0.5, 0.5, 2.0, -2.0, -1.0)


@dataclass(frozen=True)
class Transducer:
    """States are small integers; an arc gives the next state and the event it emits, if any."""

    arcs: dict[tuple[int, int], tuple[int, int | None]]
    states: int


def _countdown(trigger: int, span: int, event: int, on: tuple[int, ...]) -> Transducer:
    """Remembers ``trigger`` for ``span`` tokens; classes ``on`` emit ``event`` meanwhile."""
    arcs = {(s, kind): (span if kind == trigger else max(0, s - 1), event if s and kind in on else None) for s in range(span + 1) for kind in range(6)}
    return Transducer(arcs, span + 1)


def _latch(trigger: int, event: int, on: tuple[int, ...]) -> Transducer:
    """Remembers ``trigger`` to the clause's end."""
    return Transducer({(s, kind): (1 if kind == trigger else s, event if s and kind in on else None) for s in range(2) for kind in range(6)}, 2)


def compose(parts: list[Transducer]) -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """The product machine as tables: next state and events by state and class."""
    sizes = [p.states for p in parts]
    number = {s: i for i, s in enumerate(product(*map(range, sizes)))}
    following, events = [], []
    for states in number:
        steps = [[p.arcs[s, kind] for p, s in zip(parts, states)] for kind in range(6)]
        following.append([number[tuple(t for t, _ in step)] for step in steps])
        events.append([tuple(e for _, e in step if e is not None) for step in steps])
    return following, events


GRAMMAR = compose([
    _latch(TARGET, AFTER_TARGET, (INSULT,)),
    _countdown(INSULT, 4, AFTER_INSULT, (TARGET, INSULT)),
    _countdown(THREAT, 4, THREATENED, (TARGET,)),
    _countdown(NEGATION, 3, NEGATED, (INSULT, THREAT)),
    _latch(REPORT, REPORTED, (INSULT, THREAT)),
])


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # whole words end in a blank
    weights: list[float] = field(default_factory=lambda: [0.0] * 5)
    events: tuple[float, ...] = PRIOR

    def __post_init__(self) -> None:
        self.matcher = None
        self.added = [[sum(self.events[e] for e in step) for step in row] for row in GRAMMAR[1]]

    def _hits(self, low: str) -> tuple[dict[int, float], set[int]]:
        """Weight of the longest entry at each word start that has one, and the
        starts of threat words."""
        if self.matcher is None:
            import ahocorasick

            self.matcher = ahocorasick.Automaton()
            threats = {w for w, kind in CLASS_OF.items() if kind == THREAT}
            for bare in threats | {entry.rstrip(" ") for entry in self.lexicon}:
                self.matcher.add_word(bare, (len(bare), self.lexicon.get(bare + " "), self.lexicon.get(bare), bare in threats))
            self.matcher.make_automaton()
        longest: dict[int, tuple[int, float]] = {}
        threatened: set[int] = set()
        n = len(low)
        for end, (size, whole, prefix, threat) in self.matcher.iter(low):
            start = end + 1 - size
            if start and low[start - 1].isalpha():
                continue
            closed = end + 1 == n or not low[end + 1].isalpha()
            if threat and closed:
                threatened.add(start)
            w = whole if whole is not None and closed else prefix
            if w is not None and longest.get(start, (0, 0.0))[0] < size:
                longest[start] = (size, w)
        return {start: w for start, (_, w) in longest.items()}, threatened

    def _runs(self, text: str) -> Iterator[list[tuple[int, int, float]]]:
        """For each clause with a lexicon or threat word (no other can score): class,
        state before it and own weight of each of its words."""
        low = text.lower()
        hits, threatened = self._hits(low)
        following = GRAMMAR[0]
        spots, at = sorted(threatened.union(hits)), 0
        if not spots:
            return
        for clause in CLAUSE.finditer(low):
            if at == len(spots):
                break
            if clause.end() <= spots[at]:
                continue
            state, run = 0, []
            for m in WORD.finditer(low, clause.start(), clause.end()):
                own = hits.get(m.start())
                kind = INSULT if own is not None else CLASS_OF.get(m.group(), REST)
                run.append((kind, state, own or 0.0))
                state = following[state][kind]
            while at < len(spots) and spots[at] < clause.end():
                at += 1
            yield run

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that match."""
        scores = []
        for run in self._runs(text):
            score = 0.0
            for kind, state, own in run:
                more = self.added[state][kind]
                score += max(0.0, own + more) if kind == INSULT else max(-2.0, more) if kind == THREAT else more
            if score > 0:
                scores.append(score)
        return scores

    def emitted(self, text: str | None) -> list[float]:
        """What all clauses emit: the words' own weights, and each event's count."""
        out = [0.0] * (1 + len(EVENTS))
        for run in self._runs(text or ""):
            for kind, state, own in run:
                out[0] += own
                for e in GRAMMAR[1][state][kind]:
                    out[1 + e] += 1
        return out

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        scores = self.clauses(text)
        n = text.count(" ") + text.count("\n") + 1
        total = sum(scores)
        return [1.0, math.log1p(total), max(scores, default=0.0) / 5, 100 * total / (n + 20) / 5, math.log1p(total) * math.log(n + 20) / 8]

    def score(self, text: str | None) -> float:
        x = sum(w * f for w, f in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def entries(text: str | None) -> set[str]:
    words = {m.lower() for m in WORD.findall(text or "") if len(m) >= 3}
    return {w + " " for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(5))


def _sample(labels: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """(doc_id, label) of at most TOXIC_ROWS and CLEAN_ROWS rows by hash order,
    with the sizes of both classes outside the held-out fold."""
    own = labels.select(labels["doc_id"].cast("long").alias("__id"), labels[label].cast("int").alias("y")).dropna().where(fold(F.col("__id")) != 0)
    own = own.groupBy("__id").agg((F.max("y") > 0).cast("int").alias("y"))
    sizes = dict(own.groupBy("y").count().collect())
    order = [F.xxhash64("__id"), F.col("__id")]
    drawn = own.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionAll(own.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    return drawn, sizes.get(1, 0), sizes.get(0, 0)


def _counted(batches: Batches) -> Batches:
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

    def sums() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([c[e] for e in names], pa.int64()) for c in reversed(counts))]
        return pa.RecordBatch.from_arrays(columns, ["entry", "toxic", "clean"])

    for batch in slices(batches):
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            counts[y].update(entries(text))
            if len(counts[0]) + len(counts[1]) >= HELD:
                yield sums()
                counts = (Counter(), Counter())
    if counts[0] or counts[1]:
        yield sums()


def _judged(sample: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """entry, toxic, evidence, odds: entries whose share of toxic documents is
    beyond chance, among all that enough toxic documents hold."""
    f = n_toxic / (n_toxic + n_clean)
    total = sample.select("y", "text").mapInArrow(lean(_counted), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic"), F.col("clean")
    p = a / (a + b)
    rest = F.when(b > 0, (1 - p) * F.log((1 - p) / (1 - f))).otherwise(0.0)
    evidence = (a + b) * (p * F.log(p / f) + rest)
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_clean + 1))
    enough = total.where(a >= max(5, n_toxic // 300)).where(p > f)
    return enough.select("entry", "toxic", evidence.alias("evidence"), odds.alias("odds")).where((F.col("evidence") >= EVIDENCE) & (F.col("odds") >= 1.0))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds of the entries beyond chance; only these reach the driver."""
    found = {r["entry"]: r for r in _judged(sample, n_toxic, n_clean).collect()}
    toxic = {e: r["toxic"] for e, r in found.items()}
    # a beginning that one longer entry explains goes: "tras" where it is all "trash"
    for entry in sorted(found, key=len, reverse=True):
        for n in PREFIXES:
            if n < len(entry) and entry[:n] in found and toxic[entry] >= 0.9 * toxic[entry[:n]]:
                del found[entry[:n]]
    return {e: min(5.0, found[e]["odds"]) for e in sorted(found)}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's steps; the intercept is free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_events(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of the events in units of a word's log-odds: a logistic regression on
    what documents emit, whose ridge draws towards ``PRIOR`` and not towards zero. A
    weight keeps its prior's sign and at most doubles it; a threat keeps at least half."""
    scaled = np.log1p(x)
    scaled = np.column_stack([np.ones(len(x)), scaled[:, 0] + np.log1p(x[:, 1:]) @ np.array(PRIOR) / 4, scaled[:, 1:]])
    w = logistic(scaled, y, weight, ridge=1.0)
    unit = max(w[1], 1e-6)
    moved = [p + c / unit for p, c in zip(PRIOR, w[2:])]
    least = [0.5 * p if e == THREATENED else 0.0 for e, p in enumerate(PRIOR)]
    return tuple(float(np.clip(m, *sorted((lo, 2 * p)))) for m, lo, p in zip(moved, least, PRIOR))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    ship(docs.sparkSession)
    drawn, all_toxic, all_clean = _sample(labels, label)
    if not all_toxic or not all_clean:
        return Model({}, [math.log((all_toxic + 0.5) / (all_clean + 0.5)) if all_toxic + all_clean else -5.0, 0.0, 0.0, 0.0, 0.0])
    # at most TOXIC_ROWS + CLEAN_ROWS rows of two numbers
    sample = docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"]).join(F.broadcast(drawn), "__id")
    # as many documents, each once; dealt over all cores
    sample = materialize(sample.groupBy("__id", "y").agg(F.min("text").alias("text")).repartition(docs.sparkSession.sparkContext.defaultParallelism, "__id"), "labelled")
    n_toxic, n_clean = min(all_toxic, TOXIC_ROWS), min(all_clean, CLEAN_ROWS)
    model = Model(learn_lexicon(sample, n_toxic, n_clean))

    def gathered(of: Callable[[str | None], list[float]]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Batches) -> Batches:
            for batch in slices(batches):
                found = [of(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])

        # a row of a few numbers for each document of the sample
        rows = sorted(sample.select("y", "text").mapInArrow(lean(run), "y int, x array<double>").collect())
        return np.array([r["y"] for r in rows], float), np.array([r["x"] for r in rows])

    y, x = gathered(model.emitted)
    if not len(y):
        return Model({}, [-5.0, 0.0, 0.0, 0.0, 0.0])
    share = np.where(y == 1, all_toxic / max(1, (y == 1).sum()), all_clean / max(1, (y == 0).sum()))
    weight = share * len(y) / share.sum()
    model = Model(model.lexicon, events=learn_events(x, y, weight))
    y, x = gathered(model.features)  # the same rows' labels and weights, in another order
    share = np.where(y == 1, all_toxic / max(1, (y == 1).sum()), all_clean / max(1, (y == 0).sum()))
    return Model(model.lexicon, logistic(x, y, share * len(y) / share.sum()).tolist(), model.events)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, which replaces a column of that name."""
    ship(docs.sparkSession)
    base = docs.drop("score")
    plain = Model(model.lexicon, model.weights, model.events)

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            scores = [plain.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(lean(run), f"{kinds}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = with_score(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), fit(docs, labels, label))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
