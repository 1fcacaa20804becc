"""What the operators share: checkpoints, worker paths and memory, text columns."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import weakref
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = b" \t\n\x0b\x0c\r"


#: Bytes of keys and values that a worker's mapping keeps before it starts anew; of encoded tokens, which cost more to make.
KEEP_BYTES, KEEP_ENCODED = 8 << 20, 44 << 20
#: Bytes of an entry and a short value, without its key's own length.
ENTRY = 190
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


class Kept(dict):
    """A mapping that computes what is missing. It starts anew at ``limit`` bytes, and is emptied when a task ends."""

    every: list[weakref.ref] = []

    def __init__(self, make: Callable | None, limit: int = KEEP_BYTES):
        self.make, self.limit, self.left = make, limit, limit
        Kept.every.append(weakref.ref(self, Kept.every.remove))

    def clear(self) -> None:
        super().clear()
        self.left = self.limit

    def __missing__(self, key):
        if self.left < 0:
            self.clear()
        self.left -= ENTRY if key.__class__ is int else ENTRY + len(key)
        self[key] = value = self.make(key)
        return value

    def bound(self) -> None:
        if self.left < 0:
            self.clear()

    def put(self, key, value) -> None:
        self[key] = value
        self.left -= ENTRY + len(key)


def release() -> None:
    """Workers outlive their tasks: empties what they keep, and gives free memory back to the system."""
    for one in Kept.every:
        if (kept := one()) is not None:
            kept.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def frugal(run: Callable) -> Callable:
    """For functions over a task's batches: the worker is small again when they end."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def frugal_group(run: Callable) -> Callable:
    """The same for functions of one or two arguments over groups of several MB."""

    def freed(*of) -> pa.Table:
        try:
            return run(*of)
        finally:
            release()

    return (lambda one: freed(one)) if run.__code__.co_argcount == 1 else (lambda one, other: freed(one, other))


#: Rows that go to a Python worker together; texts are long, so Spark's own number would be hundreds of MB.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed on them, and keeps their batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables, named by spark.checkpoint.dir.

    Only a local master may go without that setting: it gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillfold-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Partitions of tables with short rows are brought together, so many to a file, before they are written.
SHORT = 8


def checkpointed(df: DataFrame, short: bool = False) -> DataFrame:
    """Cuts lineage by reliable checkpoint in the shared folder. Tables of ``short`` rows go to fewer files, as each file costs some calls of the store."""
    spark = df.sparkSession
    shared_folder(spark)
    if short:
        df = df.repartition(max(1, partitions(spark) // SHORT))
    return df.checkpoint(eager=True)


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of a text column; one scan, one row to the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)
