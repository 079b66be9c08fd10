"""Packing tokenized documents into fixed windows by non-negative least squares.

1. One pass tokenizes each text: its length and the checksums of its whole windows
   and of what remains (at most window - 1 ids) are written out, never the ids.
2. The histogram of the remainders over the whole table (at most window - 1 rows,
   whatever the corpus) is matched by repeating shallow combinations of two or
   three lengths that fill a window: non-negative least squares solves for the
   repeats, which are rounded and dealt out as far as lengths last. What is left is
   packed greedily, each next length the largest that fits; once that leaves more
   than 1/256 of a window empty, the rest is laid end to end, longest first, and cut
   where a window ends. So every sequence of the table but the last of these is full
   or nearly so, however the rows are partitioned.
3. The remainders of one length are numbered over all partitions (counts by
   partition and length, summed up); number and plan give sequence and offset.
   The few texts cut in step 2 are tokenized again for the checksums of their parts.

Defined cases: null text is empty, and each document has at least its end id, so an
empty text is a piece of one id; repeated rows are documents of their own; a null
doc_id stays null; a very long text gives whole windows and one remainder; documents
of equal length are interchangeable in the plan; an empty table gives no rows; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch, ship
from .bpe import encoder
from .common import Batches, lean, slices

FEW_CUTS = 20_000
#: of a text: its remainder's length and number among those of its partition, and its first whole window's number there
MEASURED = "doc_id long, text_hash long, part long, n long, rest int, k long, first long, whole array<long>, rest_crc long"
PIECE = "doc_id long, text_hash long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PARTS = "at long, hash long, start long, length long, crc long"


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, seeds: int = 64) -> list[tuple[int, ...]]:
    """Pairs of present lengths that fill the window, and triples whose two
    larger lengths are among ``seeds`` lengths spread evenly over the rows."""
    present = set(lengths.tolist())
    found = [(a, window - a) for a in present if a >= window - a and window - a in present]
    spread = np.unique(lengths[np.searchsorted(np.cumsum(counts), np.linspace(1, counts.sum(), seeds))]).tolist() if len(lengths) else []
    for i, a in enumerate(spread):
        for b in spread[: i + 1]:
            if 0 < window - a - b <= b and window - a - b in present:
                found.append((a, b, window - a - b))
    return sorted(found, reverse=True)


def nnls(combos: list[tuple[int, ...]], wanted: np.ndarray, sweeps: int = 12) -> list[float]:
    """Repeats x >= 0 with least squared error against the histogram, by exact
    steps on one coordinate at a time."""
    left = wanted.astype(float).tolist()
    x = [0.0] * len(combos)
    columns = [[(n, combo.count(n)) for n in set(combo)] for combo in combos]
    norms = [sum(k * k for _, k in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = max(-x[j], sum(left[n] * k for n, k in column) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in column:
                    left[n] -= step * k
        if moved < 0.05:
            break
    return x


@dataclass
class Plan:
    """Where the remainders of each length go, by their number."""

    window: int
    #: by length: first numbers of the stretches, and (uses of the length in the combination, first sequence, offset)
    bases: dict[int, list[int]] = field(default_factory=dict)
    slots: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    #: by length: the number from which remainders are laid end to end, and where on that line
    line: dict[int, tuple[int, int]] = field(default_factory=dict)
    first_of_line: int = 0
    first_whole: int = 0

    def places(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start within the remainder, length, sequence, offset) of its one or two pieces."""
        begin, at = self.line[length]
        if number < begin:
            j = bisect_right(self.bases[length], number) - 1
            uses, sequence, offset = self.slots[length][j]
            copy, use = divmod(number - self.bases[length][j], uses)
            return [(0, length, sequence + copy, offset + use * length)]
        sequence, offset = divmod(at + (number - begin) * length, self.window)
        head = min(length, self.window - offset)
        pieces = [(0, head, self.first_of_line + sequence, offset)]
        return pieces + ([(head, length - head, self.first_of_line + sequence + 1, 0)] if head < length else [])


def plan(histogram: dict[int, int], window: int) -> Plan:
    """From counts by remainder length."""
    made, used, sequence = Plan(window), Counter(), 0
    wanted = np.zeros(window + 1, np.int64)
    for n, many in histogram.items():
        wanted[n] = many
    lengths = np.flatnonzero(wanted)
    combos = combinations(lengths, wanted[lengths], window)
    solved = nnls(combos, wanted)
    for j in sorted(range(len(combos)), key=lambda j: -solved[j]):
        uses = Counter(combos[j])
        repeats = min([round(solved[j]), *((histogram[n] - used[n]) // m for n, m in uses.items())])
        if repeats > 0:
            _deal(made, uses, used, sequence, repeats)
            sequence += repeats
    sequence = _filled(made, histogram, used, sequence)
    made.first_of_line, at = sequence, 0
    for n in sorted(histogram, reverse=True):
        made.line[n] = (used[n], at)
        at += n * (histogram[n] - used[n])
    made.first_whole = sequence + -(-at // window)
    return made


def _filled(made: Plan, histogram: dict[int, int], used: Counter[int], sequence: int) -> int:
    """Deals out sequences that the largest lengths left fill greedily, each next one
    the largest that fits, as long as at most 1/256 of the window stays empty."""
    left = sorted(n for n in histogram if used[n] < histogram[n])
    while left:
        uses: Counter[int] = Counter()
        room, top = made.window, len(left)
        while top := bisect_right(left, room, 0, top):
            n = left[top - 1]
            uses[n] = min(room // n, histogram[n] - used[n])
            room -= n * uses[n]
            top -= 1
        if room > made.window >> 8:
            break
        repeats = min((histogram[n] - used[n]) // m for n, m in uses.items())
        _deal(made, uses, used, sequence, repeats)
        sequence += repeats
        left = [n for n in left if used[n] < histogram[n]] if any(used[n] == histogram[n] for n in uses) else left
    return sequence


def _deal(made: Plan, uses: Counter[int], used: Counter[int], sequence: int, repeats: int) -> None:
    """Gives the next numbers of the lengths in ``uses`` to ``repeats`` sequences."""
    offset = 0
    for n, m in uses.items():
        made.bases.setdefault(n, []).append(used[n])
        made.slots.setdefault(n, []).append((m, sequence, offset))
        used[n] += m * repeats
        offset += m * n


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    arrow = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _measured(vocabulary: str, window: int, end_id: int):
    def run(batches: Batches) -> Batches:
        part, whole_windows, numbers = TaskContext.get().partitionId(), 0, Counter()
        for batch in slices(batches):
            rows = []
            for doc_id, hash_, ids in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), encoder(vocabulary).encode(batch.column("text").to_pylist())):
                ids = np.append(ids, ids.dtype.type(end_id))
                rest = len(ids) % window
                whole = [_checksum(ids[a : a + window]) for a in range(0, len(ids) - rest, window)]
                rows.append((doc_id, hash_, part, len(ids), rest, numbers[rest], whole_windows, whole, _checksum(ids[len(ids) - rest :])))
                whole_windows += len(whole)
                numbers[rest] += 1
            yield _batch(rows, MEASURED)

    return run


def _placed(made: Plan):
    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                key, n, rest = (r["doc_id"], r["text_hash"]), r["n"], r["rest"]
                for w, crc in enumerate(r["whole"]):
                    rows.append((*key, w * made.window, made.window, crc, n, made.first_whole + (r["part"] << 36) + r["first"] + w, 0))
                if rest:
                    pieces = made.places(rest, r["number"])
                    for start, length, sequence, offset in pieces:
                        rows.append((*key, n - rest + start, length, r["rest_crc"] if len(pieces) == 1 else None, n, sequence, offset))
            yield _batch(rows, PIECE)

    return run


def _parts(vocabulary: str, end_id: int):
    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            rows = []
            for doc_id, hash_, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "parts"))):
                ids = encoder(vocabulary).encode([text])[0]
                ids = np.append(ids, ids.dtype.type(end_id))
                rows += [(doc_id, hash_, p["start"], p["length"], _checksum(ids[p["start"] : p["start"] + p["length"]])) for p in parts]
            if rows:
                yield _batch(rows, PARTS)

    return run


def _numbered(own: DataFrame, vocabulary: str, window: int, end_id: int) -> tuple[DataFrame, Plan]:
    """A row a document, with its remainder's ``number`` among those of its length, and the plan."""
    measured = materialize(own.mapInArrow(lean(_measured(vocabulary, window, end_id), vocabulary=True), MEASURED), "measured")
    counts = materialize(measured.where("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("many")), "rest-counts")
    # at most window - 1 rows, whatever the corpus
    made = plan(dict(counts.groupBy("rest").agg(F.sum("many")).collect()), window)
    before = F.sum("many").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("rest", "part", F.coalesce(before, F.lit(0)).alias("begin"))
    return measured.join(begins, ["rest", "part"], "left").withColumn("number", F.col("begin") + F.col("k")), made


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row a piece."""
    ship(docs.sparkSession)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"), docs["text"])
    with scratch(docs.sparkSession) as keep:
        numbered, made = _numbered(own, vocabulary, window, end_id)
        pieces = keep(materialize(numbered.mapInArrow(lean(_placed(made)), PIECE), "pieces"))
    cut = pieces.where("ids_crc32 is null")
    wanted = cut.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("parts")).withColumnsRenamed({"doc_id": "at", "text_hash": "hash"})
    if made.first_whole - made.first_of_line <= FEW_CUTS:  # so many texts are cut at most: theirs need no shuffle of all texts
        wanted = F.broadcast(wanted)
    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["at"]) & (own["text_hash"] == wanted["hash"])).select("doc_id", "text_hash", "text", "parts")
    # rows that repeat an id and its text have one checksum
    again = materialize(texts.mapInArrow(lean(_parts(vocabulary, end_id), vocabulary=True), PARTS).dropDuplicates(["at", "hash", "start", "length"]), "part-checksums")
    again = again.withColumnsRenamed({"start": "from", "length": "size"})
    same = cut["doc_id"].eqNullSafe(again["at"]) & (cut["text_hash"] == again["hash"]) & (cut["start"] == again["from"]) & (cut["length"] == again["size"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    found = cut.drop("ids_crc32").join(again.withColumnRenamed("crc", "ids_crc32"), same).select(*names)
    return pieces.where("ids_crc32 is not null").select(*names).unionAll(found)
