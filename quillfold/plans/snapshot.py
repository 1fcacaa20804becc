"""Snapshots: the cells as of a position with their digest, and the fold that goes on from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions.hashing import row_digest
from quillfold.operators import state
from quillfold.plans.views import Ledger
from quillfold.sources.tape import read_strict

_COLUMNS = ("pos", "idx", "t_epoch_ns", "cell", "cls", "source_pos", "amount_minor", "due_ns", "state", "flags")


class SnapshotBroken(RuntimeError):
    pass


def take(ledger: Ledger, pos: int, folder: str) -> str:
    """Writes the cells as of a position; returns their digest, which stands beside them."""
    cells = ledger.frames(pos)["cells"]
    cells.write.mode("overwrite").parquet(f"{folder}/cells")
    kept = ledger.spark.read.parquet(f"{folder}/cells")
    digest, rows = row_digest(kept, sorted(kept.columns))
    ledger.spark.createDataFrame([(pos, digest, rows)], "pos long, digest string, n long").write.mode("overwrite").parquet(f"{folder}/mark")
    return digest


def resume(spark: SparkSession, tape_folder: str, folder: str, to_pos: int | None = None) -> DataFrame:
    """Cells from a snapshot and the ledger behind it; segments before it aren't opened. A snapshot that isn't what its digest says raises."""
    mark = spark.read.parquet(f"{folder}/mark").first()
    old = spark.read.parquet(f"{folder}/cells")
    if row_digest(old, sorted(old.columns)) != (mark["digest"], mark["n"]):
        raise SnapshotBroken(folder)
    tail = read_strict(spark, tape_folder, from_pos=mark["pos"] + 1, to_pos=to_pos, torn_tail=True)
    return continued(old, state.delivered_once(state.facts_of(tail)))


def continued(old: DataFrame, facts: DataFrame) -> DataFrame:
    """Cells from those of a snapshot and the facts behind it."""
    new = facts.select(*_COLUMNS, F.col("t_epoch_ns").alias("opened_ns"), F.col("pos").alias("seen"), F.lit(1).cast("long").alias("n_before"))
    # A cell's snapshot stands for all its facts so far, as one before the tail.
    base = old.select(F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("idx"), F.col("opened_ns").alias("t_epoch_ns"), "cell", "cls", F.col("src_pos_last").alias("source_pos"), "amount_minor", "due_ns", "state", "flags", "opened_ns", F.col("pos_last").alias("seen"), F.col("n_applied").alias("n_before"))
    judged = state.replayed(base.unionByName(new))
    cells = state.cells_of(judged).drop("pos_last", "n_applied")
    more = judged.groupBy(F.col("cell").alias("_c")).agg(F.max("seen").alias("pos_last"), F.sum(F.when(F.col("verdict") == "applied", F.col("n_before"))).alias("n_applied"))
    return cells.join(more, F.col("cell") == F.col("_c")).drop("_c")
