"""What the operators and queries of this folder share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import spread

Batches = Iterator[pa.RecordBatch]
SLICE_ROWS, SLICE_BYTES = 256, 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores if it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def slices(batches: Batches, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Batches:
    """Views of Arrow batches, of at most ``rows`` rows, and of at most ``size``
    bytes where they have several rows: Python copies hold a slice, not a batch."""
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            half = part.num_rows // 2
            if half and part.nbytes > size:
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def lean(run: Callable[[Batches], Batches], vocabulary: bool = False) -> Callable[[Batches], Batches]:
    """``run`` for workers that later stages reuse: the BPE encoder is let go unless
    this task needs it (``vocabulary``), and freed memory returns to the system."""

    def wrapped(batches: Batches) -> Batches:
        held = sys.modules.get("gleaner.llm.bpe")
        if held is not None and not vocabulary:
            held._ENCODERS.clear()
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped
