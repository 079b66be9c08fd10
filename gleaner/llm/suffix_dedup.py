"""Removal of long repeated passages by column-wise suffix ordering.

Two positions are duplicates if the ``SPAN`` bytes that start there are equal.

1. Each window of SPAN bytes names an anchor: the least hash of its K-byte strings
   (leftmost if tied), so equal windows have equal anchors at equal offsets.
   Windows with one anchor are neighbours: a text becomes runs of windows, some
   150 bytes apart, and only (anchor, hash of the run's bytes, offsets) is grouped.
2. A run whose bytes occur more than once is repeated as a whole; copies end
   here, however many. Anchors with one kind of run are done. For the others,
   one run of each kind is compared, byte by byte.
3. Runs are aligned on their anchors and the suffix order of the collection is
   built column by column, from the right: each round inserts one symbol of every
   document (run) in front of its suffix. The stable order by symbol is that
   column's slice of the collection's Burrows-Wheeler transform; the common
   prefixes of neighbours follow by range minima over those of the round before.
   Suffixes of other columns need no comparison, since equal windows lie at equal
   offsets, so a round costs O(documents), not a pass over all that was inserted.
   Columns come from one sequential temporary file. A window is repeated iff the
   common prefix with a neighbour reaches SPAN.
4. Anchors with more than ``COLLECTION`` kinds of run are split into collections
   that the same construction can order in a task: runs are cut into stretches of
   ``REACHES`` windows at fixed distances from the anchor, and stretches go together
   if the bytes that all windows of such a stretch share are equal. Equal windows
   stay together, since those bytes are part of them.
5. Passages of more than 50 words may have fewer than SPAN bytes. ``shared_passages``
   finds them with the same anchors over words; they are reported, not cut.

Hashes have 128 bits. Defined cases: null text is empty; texts under SPAN bytes
have no windows; very long texts are hashed piece by piece; rows with the same id and
text are copies of each other; a null doc_id is allowed; an empty table gives no rows;
other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize as written
from ..session import scratch, ship
from .common import Batches, lean, slices
from .ngram_join import mix, word_hashes

#: Some twenty tables, most of them small: each process that a file starts counts as one more JVM until it has begun.
materialize = partial(written, plain=True)
SPAN, K = 400, 64
COLLECTION = 4_000
REACHES = (32, 8, 1)
CHUNK = 1 << 18
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SYMBOLS = np.random.default_rng(23).integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(_U)
_tables: list[tuple[np.ndarray, np.ndarray]] = []
RUNS = "__doc long, text_hash long, anchor long, run1 long, run2 long, lead int, first int, last int"


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0][0]) < n:
        size = max(2 * CHUNK, 1 << (n - 1).bit_length())
        _tables[:] = [(np.cumprod(np.full(size, b, _U)), np.cumprod(np.full(size, pow(b, -1, 1 << 64), _U))) for b in _BASES]
    return _tables[which]


class Hashes:
    """Hashes of any stretch of a buffer of bytes (or of words, given by their hashes),
    two independent ones of 64 bits."""

    def __init__(self, data: np.ndarray):
        self.total = []
        symbols = [_SYMBOLS[which][data] for which in range(2)] if data.dtype == np.uint8 else [data, mix(data ^ _U(_BASES[1]))]
        for which in range(2):
            power, _ = _power(which, len(data) + 1)
            total = np.zeros(len(data) + 1, _U)
            np.cumsum(symbols[which] * power[: len(data)], out=total[1:])
            self.total.append(total)

    def of(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.total[which][b] - self.total[which][a]) * _tables[which][1][a]
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(27))


def runs(data: np.ndarray, bounds: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, ...]:
    """Over texts that start and end at ``bounds`` of one buffer: text, anchor,
    run hashes, anchor's distance from the run's first window, first and last
    window (both inclusive, within the text)."""
    n_windows = len(data) - span + 1
    if n_windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    hashes = Hashes(data)
    at = np.arange(len(data) - k + 1)
    grams = hashes.of(0, at, at + k)
    width = span - k + 1
    low = (grams & ~_U(0xFFFFFF)) | at.astype(_U) if len(at) < 1 << 24 else grams
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n_windows], low[width - size : width - size + n_windows])
    anchor = (low[:n_windows] & _U(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(n_windows), side="right") - 1
    whole = np.arange(n_windows) + span <= bounds[text + 1]
    start = np.flatnonzero(whole & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (text[1:] != text[:-1]))))
    stop = np.flatnonzero(whole & np.concatenate(((anchor[1:] != anchor[:-1]) | ~whole[1:] | (text[1:] != text[:-1]), [True])))
    owner = text[start]
    p = anchor[start]
    begin = bounds[owner]
    signed = lambda x: x.view(np.int64)
    return owner, signed(grams[p]), signed(hashes.of(0, start, stop + span)), signed(hashes.of(1, start, stop + span)), p - start, start - begin, stop - begin


def _pieces(texts: list, span: int) -> Iterator[tuple[list[int], list[int], list]]:
    """Buffers of whole texts; longer texts in pieces that overlap by span - 1,
    so that every window is in just one piece."""
    held, offsets, size = [], [], 0
    parts: list = []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - span + 1), CHUNK):
            piece = t[at : at + CHUNK + span - 1]
            if len(piece) < span:
                continue
            if size and size + len(piece) > CHUNK:
                yield held, offsets, parts
                held, offsets, parts, size = [], [], [], 0
            held.append(i)
            offsets.append(at)
            parts.append(piece)
            size += len(piece)
    if held:
        yield held, offsets, parts


def text_runs(texts: list, span: int = SPAN, k: int = K) -> tuple[np.ndarray, ...]:
    """Runs of texts, as bytes or as arrays of word hashes."""
    out = []
    for held, offsets, parts in _pieces(texts, span):
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        data = np.frombuffer(b"".join(parts), np.uint8) if isinstance(parts[0], bytes) else np.concatenate(parts)
        owner, *rest, first, last = runs(data, bounds, span, k)
        shift = np.array(offsets)[owner] if len(owner) else 0
        out.append((np.array(held)[owner], *rest, first + shift, last + shift))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(c) for c in zip(*out))


def repeated_windows(segments: list[bytes], leads: list[int], counts: list[int], span: int = SPAN) -> list[np.ndarray]:
    """For each segment (a run's bytes, its anchor at ``lead``, holding ``counts``
    windows) which windows also occur in another segment, by column-wise
    construction of the order of suffixes and their common prefixes."""
    m = len(segments)
    leads_, counts_ = np.array(leads), np.array(counts)
    ends = np.array([len(s) for s in segments]) - leads_
    left, right = int(leads_.max()), int(ends.max())
    last_start = int((left - leads_ + counts_).max()) - 1
    with tempfile.TemporaryFile() as spool:
        columns = left + right
        band = max(1, (1 << 25) // columns)
        # documents are laid out by column, a band of them at a time
        pads = []
        for lo in range(0, m, band):
            grid = np.zeros((min(band, m - lo), columns), np.uint8)
            for r, i in enumerate(range(lo, min(m, lo + band))):
                at = left - leads[i]
                # UTF-8 has no bytes beyond 0xF4, so 0 is free for "no symbol"
                grid[r, at : at + len(segments[i])] = np.frombuffer(segments[i], np.uint8) + np.uint8(1)
            pads.append(len(grid))
            spool.write(np.ascontiguousarray(grid.T).tobytes())
        starts = np.concatenate(([0], np.cumsum(pads)))

        def column(c: int) -> np.ndarray:
            out = np.empty(m, np.uint8)
            for b, n in enumerate(pads):
                spool.seek(int(starts[b]) * columns + c * n)
                out[starts[b] : starts[b + 1]] = np.frombuffer(spool.read(n), np.uint8)
            return out

        order = np.arange(m)
        common = np.zeros(m, np.int32)  # with the one before, in order
        marks = np.zeros((m, int(counts_.max())), bool)
        for c in range(columns - 1, -1, -1):
            symbols = column(c)[order]
            place = np.argsort(symbols, kind="stable")
            ranked = symbols[place]
            following = np.zeros(m, np.int32)
            same = np.flatnonzero((ranked[1:] == ranked[:-1]) & (ranked[1:] > 0)) + 1
            if len(same):
                low = np.empty(2 * len(same), np.int64)
                low[0::2], low[1::2] = place[same - 1] + 1, place[same] + 1
                # least common prefix on the way from the one to the other
                closed = np.append(common, 0)
                following[same] = np.minimum.reduceat(closed, low)[0::2] + 1
            order, common = order[place], following
            if c <= last_start:
                hit = common >= span
                hit[:-1] |= hit[1:]
                window = c - (left - leads_[order])
                hit &= (window >= 0) & (window < counts_[order])
                marks[order[hit], window[hit]] = True
    return [marks[i, : counts[i]] for i in range(m)]


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _emit(columns: list, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _run_rows(batches: Batches) -> Batches:
    for batch in slices(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        owner, *rest = text_runs(texts)
        pick = pa.array(owner, pa.int64())
        yield _emit([batch.column("__doc").take(pick), batch.column("text_hash").take(pick), *rest], RUNS)


SEGMENTS = "anchor long, __doc long, text_hash long, lead int, first int, last int, alone int, bytes binary"


def _segment_rows(batches: Batches) -> Batches:
    for batch in slices(batches):
        out: list[list] = [[] for _ in range(8)]
        held = 0
        for doc, hash_, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("__doc", "text_hash", "text", "wanted"))):
            data = (text or "").encode()
            for w in wanted:
                row = (w["anchor"], doc, hash_, w["lead"], w["first"], w["last"], w["alone"], data[w["first"] : w["last"] + SPAN])
                for column, x in zip(out, row):
                    column.append(x)
                held += len(row[-1])
                if held > CHUNK:
                    yield _emit(out, SEGMENTS)
                    out, held = [[] for _ in range(8)], 0
        yield _emit(out, SEGMENTS)


def _stretches(reach: int) -> Callable[[Batches], Batches]:
    """Cuts segments into windows whose distances from the anchor lie in one stretch of
    ``reach``; the hash of what these windows share takes the anchor's place."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, rows=64):
            out: list[list] = [[] for _ in range(8)]
            for row in batch.to_pylist():
                hashes = Hashes(np.frombuffer(row["bytes"], np.uint8))
                lead, n = row["lead"], row["last"] - row["first"] + 1
                for stretch in range((lead - n + 1) // reach, lead // reach + 1):
                    near, far = stretch * reach, stretch * reach + reach - 1
                    a, b = max(0, lead - far), min(n - 1, lead - near)
                    # of every window at a distance from near to far: lead - near is where the last one starts
                    core = np.array([lead - near]), np.array([lead - far + SPAN])
                    group = hashes.of(0, *core) ^ hashes.of(1, *core) * _U(0x9E3779B97F4A7C15) ^ np.array([stretch + 1], _U) * _U(0xC2B2AE3D27D4EB4F)
                    cut = (int(group.view(np.int64)[0]), row["__doc"], row["text_hash"], lead - a, row["first"] + a, row["first"] + b, row["alone"], row["bytes"][a : b + SPAN])
                    for column, x in zip(out, cut):
                        column.append(x)
            yield _emit(out, SEGMENTS)

    return run


FOUND = "__doc long, text_hash long, first int, last int"


def _column_rows(collection: int, last: bool) -> Callable[[Batches], Batches]:
    """Segments sorted by anchor: whole anchors are gathered up to ``collection`` rows, and
    beyond it only where ``last``: all windows of an anchor are then equal, so that any
    two or more of them may go together."""

    def compare(rows: list[dict]) -> Batches:
        marks = repeated_windows([r["bytes"] for r in rows], [r["lead"] for r in rows], [r["last"] - r["first"] + 1 for r in rows])
        out = [(r["__doc"], r["text_hash"], r["first"] + a, r["first"] + b) for r, mask in zip(rows, marks) if r["alone"] for a, b in _ranges(mask)]
        if out:
            yield _emit(list(zip(*out)), FOUND)

    def run(batches: Batches) -> Batches:
        held: list[dict] = []
        begin = 0  # of the last anchor's rows
        for batch in slices(batches):
            for row in batch.to_pylist():
                if held and held[-1]["anchor"] != row["anchor"]:
                    begin = len(held)
                    if begin >= collection:
                        yield from compare(held)
                        held, begin = [], 0
                elif last and len(held) - begin >= 2 * max(2, collection):
                    yield from compare(held[:-collection])
                    held, begin = held[-collection:], 0
                held.append(row)
        if held:
            yield from compare(held)

    return run


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("__doc"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"), docs["text"])


def repeated_ranges(docs: DataFrame, collection: int = COLLECTION) -> DataFrame:
    """__doc, text_hash, ranges: starts of repeated windows, both ends inclusive."""
    spark = docs.sparkSession
    ship(spark)
    own = _own(docs)
    every = materialize(own.mapInArrow(lean(_run_rows), RUNS), "runs")
    twice = materialize(every.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1").select("anchor"), "anchors")
    shared = materialize(every.join(twice, "anchor"), "shared-runs")
    kind = ["anchor", "run1", "run2", "lead"]
    kinds = materialize(
        shared.groupBy(*kind).agg(F.count("*").alias("copies"), F.min(F.struct("__doc", "text_hash", "first", "last")).alias("one")),
        "kinds",
    )
    copied = materialize(kinds.where("copies > 1").select(*kind), "copied")
    whole = shared.join(copied, kind, "left_semi").select("__doc", "text_hash", "first", "last")
    rival = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1"), "rivals")
    wanted = (
        kinds.join(rival, "anchor")
        .select(
            F.col("one.__doc").alias("at"), F.col("one.text_hash").alias("hash"),
            F.struct("anchor", "lead", F.col("one.first").alias("first"), F.col("one.last").alias("last"), (F.col("copies") == 1).cast("int").alias("alone")).alias("w"),
        )
        .groupBy("at", "hash").agg(F.collect_list("w").alias("wanted"))
    )
    wanted = materialize(wanted, "wanted")
    texts = own.join(wanted, own["__doc"].eqNullSafe(wanted["at"]) & (own["text_hash"] == wanted["hash"])).select("__doc", "text_hash", "text", "wanted").dropDuplicates(["__doc", "text_hash"])
    segments = materialize(texts.mapInArrow(lean(_segment_rows), SEGMENTS), "segments")
    found = [whole]
    for reach in (*REACHES, None):
        sizes = materialize(segments.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1"), "collections")
        most = F.lit(collection if reach else 1 << 62)
        here = segments.join(sizes.where(F.col("many") <= most).select("anchor"), "anchor", "left_semi")
        found.append(here.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(_column_rows(collection, reach is None)), FOUND))
        large = sizes.where(F.col("many") > most).select("anchor")
        if large.isEmpty():
            break
        segments = materialize(segments.join(large, "anchor", "left_semi").mapInArrow(lean(_stretches(reach)), SEGMENTS), "stretches")
    return reduce(DataFrame.unionAll, found).groupBy("__doc", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


PASSAGE, PASSAGE_K = 51, 11  # words of a window, and of the strings that name its anchor
WORD_WINDOWS = "anchor long, run1 long, run2 long, lead int, lo long, hi long, offset int, w1 long, w2 long"


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode())[0]


def _word_run_rows(batches: Batches) -> Batches:
    for batch in slices(batches):
        owner, *rest = text_runs([_words(t) for t in batch.column("text").to_pylist()], PASSAGE, PASSAGE_K)
        pick = pa.array(owner, pa.int64())
        yield _emit([batch.column("__doc").take(pick), batch.column("text_hash").take(pick), *rest], RUNS)


def _word_window_rows(batches: Batches) -> Batches:
    for batch in slices(batches, rows=64):
        out: list[list[np.ndarray]] = [[] for _ in range(9)]
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            words = _words(text)
            for w in wanted:
                hashes, at = Hashes(words[w["first"] : w["last"] + PASSAGE]), np.arange(w["last"] - w["first"] + 1)
                found = [np.full(len(at), w[c]) for c in ("anchor", "run1", "run2", "lead", "lo", "hi")]
                for column, x in zip(out, [*found, at, *(hashes.of(which, at, at + PASSAGE).view(np.int64) for which in range(2))]):
                    column.append(x)
        yield _emit([np.concatenate(c) if c else [] for c in out], WORD_WINDOWS)


def _covered(batches: Batches) -> Batches:
    for batch in slices(batches):
        sizes = [sum(b - a for a, b in removed_spans([(r["first"], r["last"]) for r in x], PASSAGE)) for x in batch.column("ranges").to_pylist()]
        yield _emit([batch.column("__doc"), batch.column("text_hash"), sizes], "__doc long, text_hash long, words long")


def shared_passages(docs: DataFrame) -> DataFrame:
    """__doc, text_hash, words: of the texts that share passages of more than 50 words
    with a document of another id, how many of their words these cover.

    Windows of ``PASSAGE`` words are grouped into runs by anchors as windows of bytes
    are; runs that are equal as a whole need no more, for others of one anchor the
    windows of one run of each kind are counted by hash, with the least and the
    largest id that holds them. Ids, not copies, are compared, so a text that is
    repeated under its own id shares nothing."""
    ship(docs.sparkSession)
    own = _own(docs)
    id_ = F.coalesce("__doc", F.lit(-(2**63)))
    every = materialize(own.mapInArrow(lean(_word_run_rows), RUNS), "word-runs")
    twice = materialize(every.groupBy("anchor").agg(F.min(id_).alias("lo"), F.max(id_).alias("hi")).where("lo < hi").select("anchor"), "word-anchors")
    shared = materialize(every.join(twice, "anchor"), "shared-word-runs")
    kind = ["anchor", "run1", "run2", "lead"]
    kinds = materialize(shared.groupBy(*kind).agg(F.min(id_).alias("lo"), F.max(id_).alias("hi"), F.min(F.struct("__doc", "text_hash", "first", "last")).alias("one")), "word-kinds")
    place = ["__doc", "text_hash", "first", "last"]
    whole = shared.join(kinds.where("lo < hi").select(*kind), kind, "left_semi").select(*place)
    rival = kinds.groupBy("anchor").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1").select("anchor")
    wanted = (
        kinds.join(rival, "anchor")
        .select(F.col("one.__doc").alias("at"), F.col("one.text_hash").alias("hash"), F.struct(*kind, "lo", "hi", F.col("one.first").alias("first"), F.col("one.last").alias("last")).alias("w"))
        .groupBy("at", "hash").agg(F.collect_list("w").alias("wanted"))
    )
    wanted = materialize(wanted, "wanted-word-runs")
    texts = own.join(wanted, own["__doc"].eqNullSafe(wanted["at"]) & (own["text_hash"] == wanted["hash"])).select("__doc", "text_hash", "text", "wanted").dropDuplicates(["__doc", "text_hash"])
    windows = materialize(texts.mapInArrow(lean(_word_window_rows), WORD_WINDOWS), "word-windows")
    again = windows.groupBy("w1", "w2").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most").select("w1", "w2")
    hits = windows.where("lo = hi").join(again, ["w1", "w2"], "left_semi").groupBy(*kind).agg(F.collect_list("offset").alias("offsets"))
    part = shared.join(materialize(hits, "word-hits"), kind).select("__doc", "text_hash", "first", F.explode("offsets").alias("offset")).select("__doc", "text_hash", (F.col("first") + F.col("offset")).alias("first"))
    ranges = whole.unionAll(part.withColumn("last", F.col("first"))).groupBy("__doc", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    return ranges.mapInArrow(lean(_covered), "__doc long, text_hash long, words long")


def removed_spans(ranges: list[tuple[int, int]], span: int = SPAN) -> list[tuple[int, int]]:
    """Maximal stretches of bytes covered by windows that start in the ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + span)
        else:
            out.append([a, b + span])
    return [(a, b) for a, b in out]


CUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: int, end: int>>, kept binary, n_passage_words long"


def _marked(ranges: DataFrame, passages: DataFrame) -> DataFrame:
    """One row a text: its repeated windows, and its words in shared passages."""
    none = F.lit(None)
    both = ranges.withColumn("words", none.cast("long")).unionAll(passages.select("__doc", "text_hash", none.cast(ranges.schema["ranges"].dataType).alias("ranges"), "words"))
    return both.groupBy("__doc", "text_hash").agg(F.first("ranges", ignorenulls=True).alias("ranges"), F.max("words").alias("words"))


def remove_repeats(docs: DataFrame, collection: int = COLLECTION) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte offsets) and the kept bytes: cuts
    may fall within a character, so these are binary. ``n_passage_words`` counts the
    words of passages of more than 50 words that a document of another id shares."""
    own = _own(docs)
    with scratch(docs.sparkSession) as keep:
        with scratch(docs.sparkSession) as hand_on:
            ranges = hand_on(materialize(repeated_ranges(docs, collection), "byte-ranges"))
        found = keep(materialize(_marked(ranges, shared_passages(docs)), "ranges"))
    found = found.withColumnsRenamed({"__doc": "at", "text_hash": "hash"})
    joined = own.join(found, own["__doc"].eqNullSafe(found["at"]) & (own["text_hash"] == found["hash"]), "left").select("__doc", "text", "ranges", F.coalesce("words", F.lit(0)).alias("words"))

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            sizes, removed, spans, kept = [], [], [], []
            for text, repeated in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                data = (text or "").encode()
                own_spans = removed_spans([(r["first"], r["last"]) for r in repeated or []])
                at, parts = 0, []
                for a, b in own_spans:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                kept.append(b"".join(parts))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in own_spans])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
            columns = [batch.column("__doc"), *(pa.array(c, t) for c, t in zip((sizes, removed, spans, kept), kinds)), batch.column("words")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept", "n_passage_words"])

    return joined.mapInArrow(lean(run), CUT)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
