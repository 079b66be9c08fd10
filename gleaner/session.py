"""Session helpers: a tuned local session, shared storage and code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("GLEANER_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the master is local, as in tests, a temporary folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = getattr(spark.sparkContext, "_gleaner_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext._gleaner_dir = made
    return f"file://{made}"


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted with the ``scratch`` it
    was made in, or else when the JVM ends."""
    path = f"{shared_dir(spark)}/gleaner-{name}-{uuid.uuid4().hex}"
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    held = _held.get()
    if held is not None:
        held.append(path)
    return path


_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialized within go at its end, but for those that are passed
    (as ``materialize`` gave them) to the function it yields; these belong to the scratch around it, if there is one. Nothing
    lazy that reads the others may leave it."""
    outer, own, kept = _held.get(), [], []
    token = _held.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._gleaner_path)
        return df

    try:
        yield keep
    finally:
        _held.reset(token)
        for path in own:
            if path in kept:
                if outer is not None:
                    outer.append(path)
            else:
                files, place = _place(spark, path)
                files.delete(place, True)
                files.cancelDeleteOnExit(place)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if a small input would leave some idle: a table of one
    file is one task. Inputs of more partitions than cores pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


#: Hadoop's local files without .crc files beside them.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts lineage and
    survives lost executors, unlike cached blocks.

    Where that storage is a folder and Hadoop's native library is missing, a file and its
    .crc file start four processes ("chmod") from the executor, ``plain`` files one."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**(PLAIN_FILES if plain else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    return out


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context. Arrow batches
    of Spark's default size hold 10,000 texts at once, off the heap and in Python: where
    no other size is set, they get ``ARROW_ROWS``."""
    if spark.conf.get(ARROW_BATCH) == "10000":
        spark.conf.set(ARROW_BATCH, str(ARROW_ROWS))
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="gleaner-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "gleaner_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(target)
    context._gleaner_shipped = True
