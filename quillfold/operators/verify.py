"""Integrity of a ledger as window queries: every row against the one before it, every segment against its name.

Rows are compared inside their segment; a segment's first row is compared with a summary of the segments before
it, one row for each. So nothing but those summaries meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.schema import GENESIS

_SEG_BODY = r'^\{"first_pos":(0|[1-9][0-9]{0,19}),"prev_of_first_entry":"([^"]{64})"\}$'


def breaks(tape: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys,) seg_first_pos, line_no, problem: a row for each broken rule of scanned ledgers, which ``keys`` tell apart."""
    keys = list(keys)
    good = tape.where("scan_reason is null")
    inside = Window.partitionBy(*keys, "seg_first_pos").orderBy("line_no")
    mark = F.struct("h", "pos", "t_epoch_ns")
    earlier = Window.partitionBy(*keys).orderBy("seg_first_pos").rowsBetween(Window.unboundedPreceding, -1)
    ends = good.groupBy(*keys, "seg_first_pos").agg(F.max_by(mark, "line_no").alias("_end"))
    ends = ends.select(*keys, "seg_first_pos", F.last("_end").over(earlier).alias("_before"))
    rows = good.withColumn("_own", F.lag(mark).over(inside)).withColumn("_n", F.row_number().over(inside)).join(ends, [*keys, "seg_first_pos"], "left")
    prior = F.coalesce("_own", "_before")
    first = F.col("_n") == 1
    told = F.regexp_extract("body", _SEG_BODY, 1)
    seg_ok = F.col("body").rlike(_SEG_BODY)
    rule = lambda text, bad: F.when(bad, F.lit(text))
    is_seg = first & (F.col("k") == "seg")
    rules = F.array(
        rule("prev_link", F.col("prev") != F.coalesce(prior["h"], F.lit(GENESIS))),
        rule("position", F.col("pos") != F.coalesce(prior["pos"] + 1, F.lit(0))),
        rule("epoch", F.col("t_epoch_ns") <= prior["t_epoch_ns"]),
        rule("first_row_not_seg", first & (F.col("k") != "seg")),
        rule("seg_body_malformed", is_seg & ~seg_ok),
        rule("first_pos", is_seg & seg_ok & (told.try_cast("decimal(20,0)") != F.col("seg_first_pos"))),
        rule("prev_of_first_entry", is_seg & seg_ok & (F.regexp_extract("body", _SEG_BODY, 2) != F.col("prev"))),
        rule("not_at_genesis", is_seg & seg_ok & (F.col("seg_first_pos") == 0) & (F.col("prev") != GENESIS)),
        rule("forked", is_seg & seg_ok & (F.col("seg_first_pos") != 0) & (F.col("prev") == GENESIS)),
    )
    broken = rows.select(*keys, "seg_first_pos", "line_no", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("problem"))
    unread = tape.where("scan_reason is not null and scan_reason <> 'torn'").select(*keys, "seg_first_pos", "line_no", F.col("scan_reason").alias("problem"))
    latest = Window.partitionBy(*keys).orderBy("seg_first_pos").rowsBetween(1, Window.unboundedFollowing)
    torn = tape.groupBy(*keys, "seg_first_pos").agg(F.max(F.when(F.col("scan_reason") == "torn", F.col("line_no"))).alias("line_no")).withColumn("_next", F.max("seg_first_pos").over(latest))
    torn = torn.where("line_no is not null and _next is not null").select(*keys, "seg_first_pos", "line_no", F.lit("torn_tail").alias("problem"))
    return broken.unionByName(unread).unionByName(torn)


def report(tape: DataFrame, expected_head: str | None = None) -> dict:
    """Counts, ends and problems; ``ok`` if nothing is broken. A torn tail of the last segment is told, not a break. The ledger is scanned once."""
    tape = tape.persist()
    try:
        return _report(tape, expected_head)
    finally:
        tape.unpersist()


def _report(tape: DataFrame, expected_head: str | None) -> dict:
    good = F.col("scan_reason").isNull()
    last = tape.agg(F.max("seg_first_pos")).first()[0]
    row = tape.agg(
        F.count_if(good).alias("rows"),
        F.count_distinct("seg_first_pos").alias("segments"),
        F.min_by("pos", F.when(good, F.struct("seg_first_pos", "line_no"))).alias("first_pos"),
        F.max_by(F.struct("pos", "h"), F.when(good, F.struct("seg_first_pos", "line_no"))).alias("end"),
        F.coalesce(F.sum(F.when((F.col("scan_reason") == "torn") & (F.col("seg_first_pos") == last), F.col("pos"))), F.lit(0)).alias("torn_tail_bytes"),
    ).first()
    problems = {r["problem"]: r["n"] for r in breaks(tape).groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()}
    head = row["end"]["h"] if row["end"] else None
    if expected_head is not None and expected_head != head:
        problems["head"] = 1
    return {
        "rows": row["rows"], "segments": row["segments"], "first_pos": row["first_pos"], "last_pos": row["end"]["pos"] if row["end"] else None,
        "head": head, "torn_tail_bytes": row["torn_tail_bytes"], "problems": problems, "breaks": sum(problems.values()), "ok": not problems,
    }


def statuses(tape: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys,) ghost_segments, ghost_bytes, torn_tail_bytes, last_pos: what an opening of each ledger would find.

    Ghosts are trailing segments without a whole row; the torn bytes are those after the last whole row.
    """
    keys = list(keys)
    torn = F.col("scan_reason").eqNullSafe("torn")
    per = tape.groupBy(*keys, "seg_first_pos").agg(F.count_if(~torn).alias("lines"), F.coalesce(F.max(F.when(torn, F.col("pos"))), F.lit(0)).cast("long").alias("torn"), F.max(F.when(~torn, F.col("pos"))).alias("top"))
    last = F.max(F.when(F.col("lines") > 0, F.struct("seg_first_pos", "torn", "top")))
    ghost = F.col("seg_first_pos") > F.coalesce(F.col("_last.seg_first_pos"), F.lit(-1))
    per = per.withColumn("_last", last.over(Window.partitionBy(*keys)))
    return per.groupBy(*keys).agg(
        F.count_if(ghost).alias("ghost_segments"),
        F.coalesce(F.sum(F.when(ghost, F.col("torn"))), F.lit(0)).alias("ghost_bytes"),
        F.coalesce(F.max("_last.torn"), F.lit(0)).alias("torn_tail_bytes"),
        F.max("_last.top").alias("last_pos"),
    )


def status(tape: DataFrame) -> dict:
    """The same of one ledger."""
    row = statuses(tape).first()
    return {c: int(row[c] or 0) if row else 0 for c in ("ghost_segments", "ghost_bytes", "torn_tail_bytes")}


def kinds(tape: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return tape.where("scan_reason is null").groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"))
