"""Folds that the design names but that no code has yet: licences, allocation, independence, outbox, search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def licences(tallies: DataFrame, ceilings: DataFrame, floor: int) -> DataFrame:
    """cls, ceiling, n_eff, worst_rate, licensed: the lowest of a class's ceilings, its least graded verb, its worst rate of wrongs."""
    rate = (F.col("n_wrong") + F.col("n_reversed_late")) / F.col("n_graded")
    by = tallies.groupBy("cls").agg(F.min("n_graded").alias("n_eff"), F.max(F.when(F.col("n_graded") > 0, rate)).alias("worst_rate"))
    low = ceilings.groupBy("cls").agg(F.min("ceiling").alias("ceiling"))
    return by.join(low, "cls").select("cls", "ceiling", "n_eff", "worst_rate", ((F.col("n_eff") >= floor) & (F.col("worst_rate") <= F.col("ceiling"))).alias("licensed"))


def kappa(events: DataFrame, window: int, order: str = "seq", block: int = 1 << 16) -> DataFrame:
    """cls, order, created, removed, kappa over a trailing window of positions: work made for work confirmed done.

    Positions are windowed in blocks; what a block's first windows reach back to is given to it as well.
    """
    block = max(block, window)
    at, own = F.col(order), F.floor(F.col(order) / block)
    rows = events.select("cls", order, "created", "removed_confirmed", own.alias("_own"))
    reached = F.when(F.pmod(at, F.lit(block)) >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_block", F.explode(reached))
    trailing = Window.partitionBy("cls", "_block").orderBy(order).rangeBetween(-window, 0)
    made, done = F.sum("created").over(trailing), F.sum("removed_confirmed").over(trailing)
    found = rows.select("cls", order, made.alias("created"), done.alias("removed"), (made / F.when(done > 0, done)).alias("kappa"), (F.col("_own") == F.col("_block")).alias("_is_own"))
    return found.where("_is_own").drop("_is_own")


def allocated(asks: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Asks with ``spent`` and ``granted``: the most valuable first, while their running cost stays within the period's budget; pools apart.

    Costs run inside bands of ``width`` values; what the bands above have spent is summed by a row for each band.
    """
    rows = asks.withColumn("_band", F.floor(F.col("value") / width))
    bands = rows.groupBy("period", "pool", "_band").agg(F.sum("cost").alias("_cost"))
    above = Window.partitionBy("period", "pool").orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("period", "pool", "_band", F.coalesce(F.sum("_cost").over(above), F.lit(0)).alias("_above"))
    ranked = Window.partitionBy("period", "pool", "_band").orderBy(F.desc("value"), "ask_id").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_inside", F.sum("cost").over(ranked)).join(bands, ["period", "pool", "_band"])
    spent = (F.col("_inside") + F.col("_above")).alias("spent")
    return found.select(*asks.columns, spent).withColumn("granted", F.col("spent") <= F.col("budget"))


def independence(votes: DataFrame) -> DataFrame:
    """judge_a, judge_b, n, disagreement over decisions that both judged; judges of one base count as one vote and aren't paired.

    Votes on a decision are as many as there are judges, so pairs of judges are a bounded multiple of decisions.
    """
    a = votes.select(F.col("decision"), F.col("judge").alias("judge_a"), F.col("base").alias("base_a"), F.col("verdict").alias("va"))
    b = votes.select(F.col("decision"), F.col("judge").alias("judge_b"), F.col("base").alias("base_b"), F.col("verdict").alias("vb"))
    both = a.join(b, "decision").where("judge_a < judge_b and base_a <> base_b")
    return both.groupBy("judge_a", "judge_b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("va") != F.col("vb")).cast("double")).alias("disagreement"))


def outbox(intents: DataFrame, results: DataFrame) -> DataFrame:
    """Intended effects without a result yet, by idempotency key."""
    return intents.join(results.select("idem_key"), "idem_key", "left_anti")


def dangling(cells: DataFrame, blockers: DataFrame, key: str = "cell", ref: str = "blocked_by") -> DataFrame:
    """Cells that name a blocker that isn't there."""
    return cells.where(F.col(ref) != 0).join(blockers.select(F.col(key).alias("_there")), F.col(ref) == F.col("_there"), "left_anti")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cell_bytes: int = 64 << 20) -> DataFrame:
    """query_id, neighbour_id, rank: exhaustive cosine search of a stated query set against all rows.

    Rows are dealt to groups and queries to slices of ``cell_bytes``; each group meets each slice in one task, as two
    matrices, of which the k best of each query go on. So a row is copied once for each slice of queries, a query once
    for each group of rows. A vector isn't its own neighbour; ties go to the smaller id. Zero vectors have similarity 0.
    """
    spark = vectors.sparkSession
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    rows, asked = take(vectors), take(queries)
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)) * 8).first()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size(rows) // cell_bytes))
    slices = max(1, -(-size(asked) // cell_bytes))
    home = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("id", "v", home(groups).alias("g"), every(slices).alias("s"))
    right = asked.select("id", "v", every(groups).alias("g"), home(slices).alias("s"))

    def unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = t.column("v").combine_chunks()
        rows = np.asarray(values.flatten(), np.float64).reshape(len(values), -1)
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        return t.column("id").to_numpy(), rows / np.where(norm > 0, norm, 1)

    def best(t: pa.Table, q: pa.Table) -> pa.Table:
        out = [[], [], []]
        if t.num_rows and q.num_rows:
            (ids, m), (qids, qm) = unit(t), unit(q)
            for at in range(0, len(qids), 256):
                some = qids[at : at + 256]
                s = np.round(qm[at : at + 256] @ m.T, 12)
                s[some[:, None] == ids[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                top = np.take_along_axis(s, order, 1)
                keep = np.isfinite(top)
                for x, y in zip(out, (np.repeat(some, order.shape[1])[keep.reshape(-1)], ids[order][keep], top[keep]), strict=True):
                    x.append(y)
        kinds = {"query_id": np.int64, "neighbour_id": np.int64, "similarity": np.float64}
        return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, t)) for (n, t), x in zip(kinds.items(), out, strict=True)})

    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(best, "query_id long, neighbour_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank")
