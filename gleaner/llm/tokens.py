"""Encoding and decoding documents with the BPE automaton, and its digests.

One pass over the documents, no shuffle. Null text encodes as empty text; rows
are handled one by one, so ties, repeats and empty tables need no care; columns
of the input other than ``text`` pass through, and ``ids`` replaces one of that
name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .bpe import encoder
from .common import Batches, lean, slices


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole text."""
    ship(docs.sparkSession)
    base = docs.drop("ids")

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            ids = encoder(vocabulary).encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return base.mapInArrow(lean(run, vocabulary=True), f"{_kinds(base)}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ``ids`` spell (null: null)."""
    ship(encoded.sparkSession)
    base = encoded.drop("decoded")

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            decode = encoder(vocabulary).automaton.decode
            texts = [None if x is None else decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return base.mapInArrow(lean(run, vocabulary=True), f"{_kinds(base)}, decoded string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to:
    both operators fused, so that ids never leave the Python worker."""
    ship(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            own = encoder(vocabulary)
            ids = own.encode(batch.column("text").to_pylist())
            sizes = [len(x) for x in ids]
            sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(own.automaton.decode(x.tolist()).decode("utf-8", "replace").encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lean(run, vocabulary=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
