"""Corpus-wide line deduplication that returns keep bitmaps, not text.

Lines are hashed (128 bits) in one pass over the text. A pre-aggregated count
finds the keys held by enough documents; only their occurrences go on. These are
range-partitioned by (hash, document descending, position) and sorted, and each
partition is streamed once: the document that comes first for a hash keeps its
lines, later documents lose theirs. A hot line is spread over many ranges; for
the first and last hash of every range a small second pass over the lines kept
there (at most two hashes a range) finds the document that comes first of all.
What comes back is one zlib-compressed bitmap per document that loses lines;
text moves once, when the bitmaps are applied.

Defined cases: null or empty text is one empty line; a null ``doc_id`` counts as
one document id below all others; repeated rows with the same id and text share
a bitmap; rows with the same id and different texts count as one document but
have bitmaps of their own; an empty table gives no bitmaps; very long texts are
split into lines on the JVM and cut in Python alone in their slice; other columns,
whatever their names, pass through ``apply_bitmaps``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch, ship
from .common import Batches, lean, slices

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def _row_key(docs: DataFrame) -> list[Column]:
    """(document, text hash): equal for equal rows, whatever else they hold."""
    return [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("__doc"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("__text_hash"),
    ]


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select(*_row_key(docs), F.posexplode(F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER)
    return (
        lines.where(F.octet_length("line") >= min_chars)
        .withColumn("key", key)
        .where(F.length("key") >= min_chars)
        .select("__doc", "__text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    )


OCCURRENCE = "__doc long, __text_hash long, pos int, h1 long, h2 long"


def _first_occurrences(batches: Batches) -> Batches:
    """Over rows sorted by hash and document: those that lose their line. Lines that
    the first document of this partition's first or last hash keeps come marked as
    ``edge``: that hash may have begun in another partition."""
    names = ["__doc", "__text_hash", "pos", "h1", "h2"]
    current: tuple[int, int] | None = None
    keeper = 0
    held: list[pa.RecordBatch] = []  # lines the current hash's first document keeps
    leading = True  # the current hash is the partition's first

    def marked(batch: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, edge))], [*names, "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.select(names)
        doc, h1, h2 = (batch.column(c).to_numpy() for c in ("__doc", "h1", "h2"))
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = (h1[0], h2[0]) != current
        group = np.cumsum(new) - 1  # -1: goes on from the batch before
        starts = np.flatnonzero(new)
        lost = doc != np.append(doc[starts], keeper)[group]
        if lost.any():
            yield marked(batch.filter(pa.array(lost)), False)
        if len(starts):
            held.append(batch.filter(pa.array(~lost & (group < 0))))
            if leading and current is not None:
                yield from (marked(x, True) for x in held if x.num_rows)
            elif leading and len(starts) > 1:  # the first hash ends in this batch
                yield marked(batch.filter(pa.array(~lost & (group == 0))), True)
            leading = current is None and len(starts) == 1
            held, keeper = [], int(doc[starts[-1]])
        held.append(batch.filter(pa.array(~lost & (group == group[-1]))))
        current = (h1[-1], h2[-1])
    yield from (marked(x, True) for x in held if x.num_rows)


def pack_bits(size: int, dropped: list[int]) -> bytes:
    bits = bytearray(b"\xff" * ((size + 7) // 8))
    for p in dropped:
        bits[p >> 3] &= ~(1 << (p & 7))
    return zlib.compress(bytes(bits))


def _bitmaps(batches: Batches) -> Batches:
    for batch in slices(batches):
        packed = [pack_bits(max(p) + 1, p) for p in batch.column("dropped").to_pylist()]
        # lines beyond the last dropped one are not in the bitmap: they are kept
        yield pa.RecordBatch.from_arrays([batch.column("__doc"), batch.column("__text_hash"), pa.array(packed, pa.binary())], ["__doc", "__text_hash", "bitmap"])


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(__doc, __text_hash, bitmap) for the documents that lose lines.

    A bit of 0 drops the line at that position; lines past the end stay.
    """
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(materialize(_line_bitmaps(docs, min_chars, min_docs), "bitmaps"))


def _line_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    seen = materialize(line_occurrences(docs, min_chars), "lines")
    counted = seen.groupBy("h1", "h2").agg(F.count_distinct("__doc").alias("n_docs"))
    # written out, so that the join below reads both sides from plain exchanges, which can be split where a line is hot
    frequent = materialize(counted.where(F.col("n_docs") >= min_docs).select("h1", "h2"), "frequent")
    hot = materialize(seen.join(frequent, ["h1", "h2"]), "hot-lines")
    order = [F.col("h1"), F.col("h2"), F.col("__doc").desc(), F.col("pos")]
    streamed = hot.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_first_occurrences), f"{OCCURRENCE}, edge boolean")
    streamed = materialize(streamed, "occurrences")
    edges = streamed.where("edge")
    first = edges.groupBy("h1", "h2").agg(F.max("__doc").alias("first"))
    late = edges.join(first, ["h1", "h2"]).where("__doc <> first")
    place = ["__doc", "__text_hash", "pos"]
    lost = streamed.where("not edge").select(*place).unionAll(late.select(*place))
    return (
        lost.groupBy("__doc", "__text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
        .mapInArrow(lean(_bitmaps), "__doc long, __text_hash long, bitmap binary")
    )


def _kept(text: str | None, bitmap: bytes | None) -> tuple[list[str], list[str]]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, lines
    bits = zlib.decompress(bitmap)
    n = len(bits) * 8
    return lines, [x for i, x in enumerate(lines) if i >= n or bits[i >> 3] >> (i & 7) & 1]


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut down to its kept lines, plus ``n_lines`` and
    ``n_dropped``. Columns of these names in the input are replaced."""
    ship(docs.sparkSession)
    base = docs.drop("n_lines", "n_dropped")
    names = base.columns
    text = f"c{names.index('text')}"
    # columns go by their place, so that none can clash with the join's own
    renamed = base.select(*_row_key(base), *(base[c].alias(f"c{i}") for i, c in enumerate(names)))
    joined = renamed.join(bitmaps, ["__doc", "__text_hash"], "left").drop("__doc", "__text_hash")
    own = [f"c{i}" for i in range(len(names))]

    def cut(batches: Batches) -> Batches:
        for batch in slices(batches):
            texts, counts, gone = [], [], []
            for t, bitmap in zip(batch.column(text).to_pylist(), batch.column("bitmap").to_pylist()):
                lines, kept = _kept(t, bitmap)
                texts.append(t if bitmap is None else "\n".join(kept))
                counts.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*own, "n_lines", "n_dropped"])

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, base.schema.fields))
    return joined.mapInArrow(lean(cut), f"{kinds}, n_lines long, n_dropped long").toDF(*names, "n_lines", "n_dropped")
