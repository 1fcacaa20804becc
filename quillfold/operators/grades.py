"""Grades of decisions by what the world did afterwards.

The log has rows of kinds verb, fact, judgment, tick and human, in order of seq. A verb opens a decision with a
horizon. Facts and judgments on its cell, and the first tick past the horizon, may grade it; the first that
does is final. Ticks are global: each decision's tick is found by block-wise searches, as time never goes back
along the log. The rest happens inside a cell, in one ordered pass whose state is the cell's open decisions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.hashing import blake2b_hex
from quillfold.operators.blocks import next_above, running_last, running_max
from quillfold.operators.ordered import ordered_fold
from quillfold.schema import GENESIS, VERBS

# Fixed values, in order of their numbers.
VERDICTS = ("ungraded_yet", "right", "wrong", "ungradable", "reversed_late")
HOLD, ACT, WORK, FETCH, ESCALATE = (VERBS[v] for v in ("hold", "act", "work", "fetch", "escalate"))


@dataclass(frozen=True)
class Horizons:
    act: int
    work: int
    fetch: int
    hold: int
    hold_no_deadline: int
    escalate_arrival: int
    escalate_resolved: int

    def licensable(self) -> bool:
        """All seven are finite and not zero."""
        return all(0 < x < 1 << 63 for x in astuple(self))

    def of(self, verb: Column, at: Column, due: Column) -> Column:
        lit = lambda x: F.lit(x).cast("long")
        hold = F.when(due != 0, due + lit(self.hold)).otherwise(at + lit(self.hold_no_deadline))
        return (
            F.when(verb == ACT, at + lit(self.act)).when(verb == WORK, at + lit(self.work)).when(verb == FETCH, at + lit(self.fetch)).when(verb == HOLD, hold)
            .when(verb == ESCALATE, at + lit(self.escalate_arrival + self.escalate_resolved)).otherwise(at)
        )


LOG = "seq long, k string, pos long, cell long, cls long, verb int, at_ns long, due_ns long, counterfactual int, source int, reverses_pos long, closed boolean, reworked boolean, reopened boolean, crossed boolean, cap_hit boolean"
GRADED = "seq long, pos long, cell long, cls long, verb int, source int, horizon_ns long, verdict string, graded_at_ns long"


def decisions(log: DataFrame, horizons: Mapping[int, Horizons], seq_block: int = 1_000_000, ns_block: int = 3_600_000_000_000) -> DataFrame:
    """A row for each verb of the log (schema LOG) with its verdict; a class without horizons has its verbs end at once.

    Two intermediate tables stay cached until ``spark.catalog.clearCache()`` or the session's end.
    """
    horizon = F.col("at_ns")
    for cls, h in horizons.items():
        horizon = F.when(F.col("cls") == cls, h.of(F.col("verb"), F.col("at_ns"), F.col("due_ns"))).otherwise(horizon)
    clock = running_max(log, "seq", F.when(F.col("k") != "human", F.col("at_ns")), "now_ns", seq_block)
    # Read several times below: cached, and computed anew from its lineage where an executor is lost.
    clock = running_last(clock, "seq", F.when(F.col("k") == "human", F.col("verb")), "human_verb", seq_block).persist()
    ticks = clock.where("k = 'tick'").select(F.col("seq").alias("tick_seq"), F.col("now_ns").alias("tick_now"))
    verbs = clock.where("k = 'verb'").withColumn("horizon_ns", horizon)
    verbs = next_above(verbs, "seq", ticks, "tick_seq", "tick_seq", "_after", seq_block).persist()
    verbs = next_above(verbs, "horizon_ns", ticks, "tick_now", "tick_seq", "_past", ns_block)
    # Both are ticks and time is monotone along them, so the later one meets both conditions.
    verbs = verbs.withColumn("tick_seq", F.when(F.col("_after").isNotNull() & F.col("_past").isNotNull(), F.greatest("_after", "_past")))
    verbs = verbs.join(ticks.select("tick_seq", F.col("tick_now").alias("tick_at")), "tick_seq", "left").drop("_after", "_past")
    rest = clock.where("k in ('fact', 'judgment')")
    columns = [*(c.split()[0] for c in LOG.split(", ")), "human_verb", "horizon_ns", "tick_seq", "tick_at"]
    rows = verbs.unionByName(rest, allowMissingColumns=True).select(columns)
    return ordered_fold(rows, ["cell"], ["seq"], lambda row: _Open(), _step, _finish, GRADED)


def _row(d: dict, verdict: str, at: int) -> tuple:
    return (d["seq"], d["pos"], d["cell"], d["cls"], d["verb"], d["source"], d["horizon_ns"], verdict, at)


def _ticked(d: dict) -> tuple:
    """The verdict of a decision's first tick past its horizon."""
    if d["tick_seq"] is None:
        return _row(d, "ungraded_yet", 0)
    verb, due, at = d["verb"], d["due_ns"], d["tick_at"]
    if verb in (ACT, WORK):
        return _row(d, "right", at)
    if verb == HOLD and due != 0 and due <= at or verb == FETCH:
        return _row(d, "wrong", at)
    return _row(d, "ungradable", at)


def _by_fact(d: dict, row: dict) -> str | None:
    inside = row["at_ns"] <= d["horizon_ns"]
    verb = d["verb"]
    if verb in (ACT, WORK):
        if row["reverses_pos"] == d["pos"] or row["reworked"] or row["reopened"]:
            return "wrong" if inside else "reversed_late"
        return "right" if row["closed"] and inside else None
    if not inside:
        return None
    if verb == HOLD:
        return "right" if row["closed"] else None
    if verb == ESCALATE:
        human = HOLD if row["human_verb"] is None else row["human_verb"]
        return "wrong" if human == d["counterfactual"] else "right"
    if verb == FETCH:
        return "right" if d.get("margin") else None
    return None


class _Open:
    """A cell's open decisions; those whose tick is past go when the lists are looked at or have doubled."""

    def __init__(self):
        self.fetch: list[dict] = []
        self.rest: list[dict] = []
        self.limit = 64


def _expired(open_: list[dict], seq: int, out: list[tuple]) -> list[dict]:
    left = []
    for d in open_:
        if d["tick_seq"] is not None and d["tick_seq"] < seq:
            out.append(_ticked(d))
        else:
            left.append(d)
    return left


def _step(state: _Open, row: dict) -> tuple[_Open, list[tuple]]:
    out: list[tuple] = []
    kind = row["k"]
    if kind == "verb":
        (state.fetch if row["verb"] == FETCH else state.rest).append(row)
        if len(state.fetch) + len(state.rest) > state.limit:
            state.fetch, state.rest = (_expired(x, row["seq"], out) for x in (state.fetch, state.rest))
            state.limit = 2 * (len(state.fetch) + len(state.rest)) + 64
        return state, out
    if kind == "fact":
        left = []
        for d in _expired(state.rest, row["seq"], out):
            verdict = _by_fact(d, row)
            if verdict:
                out.append(_row(d, verdict, row["at_ns"]))
            else:
                left.append(d)
        state.rest = left
    left = []
    for d in _expired(state.fetch, row["seq"], out):
        verdict = None
        if kind == "fact":
            verdict = _by_fact(d, row)
        else:
            d["margin"] = row["crossed"]
            if row["at_ns"] <= d["horizon_ns"]:
                verdict = "right" if row["crossed"] and not row["cap_hit"] else "wrong"
        if verdict:
            out.append(_row(d, verdict, row["at_ns"]))
        else:
            left.append(d)
    state.fetch = left
    return state, out


def _finish(state: _Open) -> list[tuple]:
    return [_ticked(d) for d in (*state.fetch, *state.rest)]


def tallies(graded: DataFrame, by: Sequence[str] = ("cls", "verb")) -> DataFrame:
    """Counts of verdicts; ``graded`` are those with an outcome. Sources aren't pooled unless left out of ``by``."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    out = graded.groupBy(*by).agg(*[count(v).alias(f"n_{v}") for v in VERDICTS], F.count(F.lit(1)).alias("n"))
    return out.withColumn("n_graded", F.col("n_right") + F.col("n_wrong") + F.col("n_reversed_late"))


def ungradable_fraction(graded: DataFrame) -> DataFrame:
    return graded.groupBy("cls").agg(F.avg((F.col("verdict") == "ungradable").cast("double")).alias("ungradable_fraction"))


def calibration(graded: DataFrame, verbs: Sequence[int], floor: int, ceiling: float, canary: int = 2, canary_verb: int = ACT) -> DataFrame:
    """cls, calibrated, reason: every verb has ``floor`` grades (else the first that hasn't is named), so have canary acts alone, and few are ungradable."""
    outcome = F.col("verdict").isin("right", "wrong", "reversed_late")
    rows = graded.groupBy("cls").agg(
        *[F.count_if((F.col("verb") == v) & outcome).alias(f"v{v}") for v in verbs],
        F.count_if((F.col("source") == canary) & (F.col("verb") == canary_verb) & outcome).alias("canary"),
        F.avg((F.col("verdict") == "ungradable").cast("double")).alias("ungradable_fraction"),
    )
    reason = F.when(F.col("canary") < floor, "canary").when(F.col("ungradable_fraction") > ceiling, "ungradable_fraction")
    for v in reversed(list(verbs)):
        reason = F.when(F.col(f"v{v}") < floor, F.lit(f"verb {v}")).otherwise(reason)
    return rows.select("cls", reason.isNull().alias("calibrated"), reason.alias("reason"))


def grades_digest(graded: DataFrame, block: int = 1 << 16) -> str:
    """Over decisions in the order they were fed: blocks of positions are hashed where they are, and the driver chains a hash for each block."""
    numbers = {v: i for i, v in enumerate(VERDICTS)}
    columns = ("pos", "cell", "cls", "verb", "verdict", "graded_at_ns")

    def hashed(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        out = bytearray()
        for row in zip(*(t.column(c).to_pylist() for c in columns), strict=True):
            for x in row:
                out += ((numbers[x] if isinstance(x, str) else int(x)) & (1 << 64) - 1).to_bytes(8, "little")
        return pa.table({"block": t.column("block")[:1], "h": [blake2b_hex(bytes(out))]})

    rows = graded.select("seq", *columns, F.floor(F.col("seq") / block).cast("long").alias("block"))
    head = GENESIS
    for r in rows.groupBy("block").applyInArrow(hashed, "block long, h string").orderBy("block").toLocalIterator():
        head = blake2b_hex((head + r["h"]).encode())
    return head
