"""The supplied tables as ledger inputs: events as facts, requests and a decision log; orders as cells and as a grain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.operators.rules import ClassDef, ClassMap, RevRule
from quillfold.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def class_map() -> ClassMap:
    classes = ClassMap()
    classes.add(ClassDef.of(1, "click", {"small": "amount_minor <= 20000", "ratio": "1000 / state >= 250 || amount_minor < 5000"}, rules=(RevRule("*", "*", "reversible_by_inverse"), RevRule("*", "insert", "irreversible"))))
    classes.add(ClassDef.of(2, "error", {"due": "due_ns == 0 || due_ns >= now_ns"}, rules=(RevRule("error", "*", "reversible_within", 60), RevRule("*", "update", "reversible_by_inverse"))))
    classes.add(ClassDef.of(3, "purchase", {"wide": "min(amount_minor, 100) * 92233720368547758 > 0"}, rules=(RevRule("purchase", "update", "reversible_by_inverse"),), cap_minor_per_period=25_000))
    classes.add(ClassDef.of(5, "view", {"mod": "amount_minor % (state - 2) == 0 && !(flags > 0)"}))
    return classes


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts; source positions fall back and repeat, so some are stale and some duplicates."""
    e = table(spark, sf_dir, "events")
    cls = F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END")
    t = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(
        (F.col("event_id") + 1).alias("pos"),
        F.lit(0).alias("idx"),
        t.alias("t_epoch_ns"),
        F.col("user_id").alias("cell"),
        cls.cast("long").alias("cls"),
        (F.call_function("div", F.col("event_id"), F.lit(300)) * 2 + 10 - F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).cast("long").alias("source_pos"),
        F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0)).alias("amount_minor"),
        F.when(F.col("event_id") % 5 == 0, F.lit(0).cast("long")).otherwise(t + (F.col("event_id") % 11 - 4) * F.lit(3_600_000_000_000)).alias("due_ns"),
        (F.col("event_id") % 5).cast("short").alias("state"),
        F.when(F.col("event_id") % 17 == 0, 1).otherwise(0).cast("short").alias("flags"),
        F.col("event_type").alias("table"),
        F.when(F.col("event_id") % 5 == 0, "insert").otherwise("update").alias("op"),
        (F.col("event_type") == "error").alias("exogenous"),
        (F.col("event_id") % 4 != 0).alias("has_inverse"),
    )


#: The same in SQL, for the checks.
FACTS_SQL = """
f AS (
  SELECT event_id + 1 AS pos, 0 AS idx, epoch_us(ts) * 1000 AS t_epoch_ns, user_id AS cell,
    CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS cls,
    CAST(event_id // 300 * 2 + 10 - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS source_pos,
    coalesce(CAST(round(value * 100) AS BIGINT), 0) AS amount_minor,
    CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_us(ts) * 1000 + (event_id % 11 - 4) * 3600000000000 END AS due_ns,
    CAST(event_id % 5 AS BIGINT) AS state, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS flags,
    event_type AS tbl, CASE WHEN event_id % 5 = 0 THEN 'insert' ELSE 'update' END AS op, event_type = 'error' AS exogenous, event_id % 4 <> 0 AS has_inverse
  FROM events),
v AS (
  SELECT *, CASE WHEN top IS NULL OR source_pos > top THEN 'applied' WHEN source_pos = top THEN 'dup' ELSE 'stale_source' END AS verdict
  FROM (SELECT *, max(source_pos) OVER (PARTITION BY cell ORDER BY pos, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f)),
c AS (
  SELECT cell, (last).cls AS cls, (last).amount_minor AS amount_minor, (last).due_ns AS due_ns, (last).state AS state, (last).flags AS flags, (last).source_pos AS src_pos_last, opened_ns, pos_last, n_applied
  FROM (
    SELECT cell, arg_max({'cls': cls, 'amount_minor': amount_minor, 'due_ns': due_ns, 'state': state, 'flags': flags, 'source_pos': source_pos}, CASE WHEN verdict = 'applied' THEN pos END) AS last,
      arg_min(t_epoch_ns, pos) AS opened_ns, max(pos) AS pos_last, count(*) FILTER (verdict = 'applied') AS n_applied
    FROM v WHERE verdict <> 'stale_source' GROUP BY cell))"""


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells of the lattice."""
    o = table(spark, sf_dir, "orders")
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    return o.select(
        F.col("o_orderkey").alias("cell"),
        (F.col("o_custkey") % 4).cast("long").alias("seg"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("cls"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_minor"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(0).cast("long")).otherwise(t).alias("due_ns"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 0 ELSE 2 END").cast("short").alias("state"),
        F.when(F.col("o_orderkey") % 29 == 0, 1).otherwise(0).cast("short").alias("flags"),
    )


CELLS_SQL = """
k AS (
  SELECT o_orderkey AS cell, CAST(o_custkey % 4 AS BIGINT) AS seg, CAST(left(o_orderpriority, 1) AS BIGINT) AS cls, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
    CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE epoch_us(o_orderdate) * 1000 END AS due_ns,
    CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 0 ELSE 2 END AS state, CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS flags
  FROM orders)"""


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a decision log: kinds by type, verbs on most clicks and views, ticks on sign-ups."""
    f = facts(spark, sf_dir)
    e = F.col("pos") - 1
    kind = F.expr("CASE WHEN cls = 4 THEN 'tick' WHEN cls = 3 THEN 'fact' WHEN cls = 2 AND pos % 4 = 0 THEN 'human' WHEN cls = 2 THEN 'judgment' ELSE 'verb' END")
    long0 = F.lit(0).cast("long")
    return f.select(
        e.alias("seq"), kind.alias("k"), F.col("pos"), (F.col("cell") % 40).alias("cell"), (F.col("cell") % 3).alias("cls"), (e % 5).cast("int").alias("verb"),
        F.col("t_epoch_ns").alias("at_ns"), F.when(e % 2 == 0, long0).otherwise(F.col("t_epoch_ns") + (e % 7) * F.lit(600_000_000_000)).alias("due_ns"),
        (e % 3).cast("int").alias("counterfactual"), (e % 4).cast("int").alias("source"), long0.alias("reverses_pos"),
        (e % 2 == 0).alias("closed"), (e % 23 == 0).alias("reworked"), (e % 31 == 0).alias("reopened"), (e % 2 == 1).alias("crossed"), (e % 13 == 0).alias("cap_hit"),
    )
