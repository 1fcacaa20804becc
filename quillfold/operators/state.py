"""Folds of facts into current cells and exposure by class.

Facts are rows: pos and idx (their order), cell, cls, source_pos, amount_minor, due_ns, state, flags, t_epoch_ns.
Order is by (pos, idx), never by source_pos. Every fold is a function of the ledger up to a position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions.hashing import cell_id_column
from quillfold.schema import TICK_BODY, TX_BODY

#: The writer's field order; a body that departs from it isn't read.
_STRICT = r'^\{"client_id":".*","request_id":".*","basis_pos":\d+,"reversibility":"[a-z_]*","facts":\[.*\]\}$'


def facts_of(tape: DataFrame) -> DataFrame:
    """The facts of tx rows; bodies that can't be read give none (``unreadable_tx`` counts them)."""
    body = F.from_json("body", TX_BODY)
    rows = tape.where((F.col("k") == "tx") & F.col("body").rlike("(?s)" + _STRICT)).withColumn("tx", body).where("tx.facts is not null")
    facts = rows.select("pos", "t_epoch_ns", "by", F.col("tx.client_id").alias("client_id"), F.col("tx.request_id").alias("request_id"), F.posexplode("tx.facts").alias("idx", "fact"))
    return facts.select(
        "pos", "idx", "t_epoch_ns", "by", "client_id", "request_id",
        cell_id_column(F.col("fact.source"), F.col("fact.table"), F.col("fact.key")).alias("cell"),
        "fact.source", "fact.table", "fact.key", "fact.op", "fact.source_pos", "fact.cls", "fact.exogenous", "fact.has_inverse", "fact.reverses_pos",
        "fact.after.amount_minor", "fact.after.due_ns", "fact.after.state", "fact.after.flags",
    )


def unreadable(tape: DataFrame) -> DataFrame:
    """The tx rows whose body can't be read."""
    read = F.col("body").rlike("(?s)" + _STRICT) & F.from_json("body", TX_BODY)["facts"].isNotNull()
    return tape.where("k = 'tx'").where(~F.coalesce(read, F.lit(False)))


def unreadable_tx(tape: DataFrame) -> int:
    return unreadable(tape).count()


def cap_ticks(tape: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys,) positions at which exposure starts anew."""
    return tape.where("k = 'tick'").where(F.from_json("body", TICK_BODY)["cadence_rule"] == "cap_period").select(*keys, "pos")


def as_of(df: DataFrame, pos: int | None) -> DataFrame:
    return df if pos is None else df.where(F.col("pos") <= pos)


def delivered_once(facts: DataFrame) -> DataFrame:
    """Redelivered positions count once."""
    return facts.dropDuplicates(["pos", "idx"])


def admitted(facts: DataFrame) -> DataFrame:
    """``verdict`` of each fact by its source position: applied, dup or stale_source.

    Refused facts lie below the accepted maximum, so the maximum over all earlier facts is the accepted one.
    """
    before = Window.partitionBy("cell").orderBy("pos", "idx").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("source_pos").over(before)
    verdict = F.when(top.isNull() | (F.col("source_pos") > top), "applied").when(F.col("source_pos") == top, "dup").otherwise("stale_source")
    return facts.withColumn("verdict", verdict)


def replayed(facts: DataFrame) -> DataFrame:
    """``verdict`` as replay has it: what is on the ledger applies in order, except for an unchanged source position."""
    last = F.lag("source_pos").over(Window.partitionBy("cell").orderBy("pos", "idx"))
    return facts.withColumn("verdict", F.when(F.col("source_pos") == last, "dup").otherwise("applied"))


def cells_of(facts: DataFrame) -> DataFrame:
    """Current cells from facts with a verdict: the last applied one by (pos, idx) decides.

    One aggregate by cell with map-side combining; a hot cell sends one row from each task.
    """
    order = F.struct("pos", "idx")
    applied = F.col("verdict") == "applied"
    kept = facts.where("verdict in ('applied', 'dup')")
    last = F.struct("cls", "amount_minor", "due_ns", "state", "flags", "source_pos")
    out = kept.groupBy("cell").agg(
        F.max_by(F.when(applied, last), F.when(applied, order)).alias("last"),
        F.min_by("t_epoch_ns", order).alias("opened_ns"),
        F.max("pos").alias("pos_last"),
        F.count(F.when(applied, F.lit(1))).alias("n_applied"),
    )
    return out.select("cell", "last.cls", "last.amount_minor", "last.due_ns", "last.state", "last.flags", F.col("last.source_pos").alias("src_pos_last"), "opened_ns", "pos_last", "n_applied")


def increases(facts: DataFrame) -> DataFrame:
    """Applied facts with ``increase``: what each adds to its class's exposure; a fall gives nothing back."""
    applied = facts.where("verdict = 'applied'")
    before = F.lag("amount_minor").over(Window.partitionBy("cell").orderBy("pos", "idx"))
    return applied.withColumn("increase", F.greatest(F.col("amount_minor") - F.coalesce(before, F.lit(0)), F.lit(0).cast("long")))


def caps_of(facts: DataFrame, last_tick: int = -1) -> DataFrame:
    """Exposure used by class since the position of the last cap period tick."""
    return increases(facts).where(F.col("pos") > last_tick).groupBy("cls").agg(F.sum("increase").alias("cap_used"))


def last_cap_tick(tape: DataFrame) -> int:
    found = cap_ticks(tape).agg(F.max("pos")).first()[0]
    return -1 if found is None else found


def rebuild(tape: DataFrame, pos: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and caps by replay of the ledger up to a position."""
    upto = as_of(tape, pos)
    facts = replayed(delivered_once(facts_of(upto)))
    return cells_of(facts), caps_of(facts, last_cap_tick(upto))
