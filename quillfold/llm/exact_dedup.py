"""Exact dedup by skew-safe combining; DataFrame operations only.

Equal texts meet in three steps, and each step groups by the whole text, never by the digest alone:

1. local: the partial aggregate of a task merges the equal texts of its partition;
2. salted: a digest's local winners go to one of ``salts`` reducers, by the task they come from;
3. global: the salt winners, at most ``salts`` for a text, meet by digest.

So a group of any size sends one row for each task and text to the first shuffle and ``salts`` rows to the
second. Documents learn their group by a join on the digest with the groups of two rows or more. Groups that have
a ``1 / HOT`` of all repeated rows are at most HOT, so they are broadcast, and their rows are shuffled anywhere. A
digest that turns out to have several texts is joined by text as well.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import text_of

#: Most groups that are broadcast.
HOT = 1000
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null is empty."""
    return F.regexp_replace(text_of(text), WHITE, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest=sha256_hex, keep: list[str] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``, and ``row``, a struct of the columns ``keep``, if given.

    Null text counts as empty. Ties: the smallest id stays. Rows that repeat an id with the same text are one
    document given twice: they count in group_size and carry the same kept. A null id never beats another
    id; a group with null ids only keeps its rows. A very long text is compared whole. Other columns are ignored,
    whatever their names. An empty table gives no rows. ``digest`` maps a text column to a string column and may
    collide.
    """
    row = [F.struct(*keep).alias("row")] if keep is not None else []
    own = ["doc_id", "digest", *["row"] * len(row)]
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), *row)
    base = base.withColumn("digest", digest(F.col("norm")))
    salted = (
        base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    )
    texts = salted.repartition("digest").groupBy("digest", "norm").agg(F.min("winner").alias("winner"), F.sum("n").alias("n"))
    groups = (
        texts.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("winner").alias("winner"), F.sum("n").alias("n"))
        .where("n > 1")
    )
    groups = groups.persist(StorageLevel.DISK_ONLY)
    total = groups.agg(F.sum("n").alias("n"), F.coalesce(F.max("texts"), F.lit(0)).alias("texts")).first()
    lone = groups.where("texts = 1")
    rows = base.select(*own)
    if total["texts"] > 1:
        mixed = groups.where("texts > 1").select("digest")
        again = base.join(mixed, "digest", "left_semi")
        by_text = again.groupBy("digest", "norm").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        several = again.join(by_text, ["digest", "norm"]).select(*own, "winner", "n")
        rows = rows.join(mixed, "digest", "left_anti")
    often = F.col("n") * HOT >= (total["n"] or 0)
    hot = lone.where(often).select(F.col("digest").alias("_hot"), F.struct("winner", "n").alias("_one"))
    rare = lone.where(~often).select(F.col("digest").alias("_rare"), F.struct("winner", "n").alias("_other"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    # What is found already needs no partner: any other key will do, and each row has its own.
    key = F.when(F.col("_one").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("_key", key).join(rare, F.col("_key") == F.col("_rare"), "left")
    group = F.coalesce("_one", "_other")
    found = rows.select(*own, group["winner"].alias("winner"), group["n"].alias("n"))
    if total["texts"] > 1:
        found = found.unionByName(several)
    first = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("winner"))
    return found.select(
        "doc_id",
        first.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(first).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *own[2:],
    )
