"""Admission of proposed facts in batch: each against committed state, never against its neighbours.

One left join to the cells, then a CASE in the order of the rules; the class map is a declaration and compiles
into it. A request is refused by its first failing fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.operators.rules import ClassMap, constraint_row


def first_requests(requests: DataFrame, order: str = "seq") -> DataFrame:
    """Adds ``fault``: duplicate_request for all but the first of a client's request id."""
    nth = F.row_number().over(Window.partitionBy("client_id", "request_id").orderBy(order))
    return requests.withColumn("fault", F.when(nth > 1, F.lit("duplicate_request")))


def request_faults(requests: DataFrame, max_facts: int = 1000, order: str = "seq") -> DataFrame:
    """Adds ``fault``, by the first rule that a request breaks before its facts are looked at; null if it breaks none.

    Requests: client_id, request_id, n_facts, basis_pos, and committed, the last public position when it came. A
    request is a duplicate of one with its ids that got as far as being judged.
    """
    large, nameless = F.col("n_facts") > max_facts, (F.col("client_id") == "") | (F.col("request_id") == "")
    stale = F.col("basis_pos") > F.col("committed")
    answered = (~large & ~nameless & ~stale).cast("int")
    before = Window.partitionBy("client_id", "request_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce(F.sum(answered).over(before), F.lit(0)) > 0
    return requests.withColumn("fault", F.when(large, "too_large").when(nameless, "malformed").when(again, "duplicate_request").when(stale, "stale_basis"))


def judged_facts(facts: DataFrame, cells: DataFrame, class_map: ClassMap, caps: DataFrame | None = None, seam_hash: str = "") -> DataFrame:
    """Facts with ``reason`` and ``constraint_id`` (null: admitted) and ``dup`` (an unchanged source position: nothing to do).

    Facts: seq, idx, kind, by, cell, source, table, key, op, cls, source_pos, amount_minor, due_ns, state, flags,
    exogenous, has_inverse, declared_reversibility, now_ns. Cells: those of ``cells_of``; with columns
    source, table, key ids that meet are told apart. Caps: cls, cap_used of the running period.
    """
    known = [c for c in ("source", "table", "key") if c in cells.columns]
    now = cells.select(F.col("cell").alias("_cell"), F.col("amount_minor").alias("_amount"), F.col("src_pos_last").alias("_last"), F.col("opened_ns").alias("_opened"), F.col("pos_last").alias("_pos"), *[F.col(c).alias(f"_{c}") for c in known])
    rows = facts.join(now, F.col("cell") == F.col("_cell"), "left")
    if caps is not None:
        # A row for each class: as small as the class map.
        rows = rows.join(F.broadcast(caps.where(class_map.known(F.col("cls"))).select(F.col("cls").alias("_cls"), "cap_used")), F.col("cls") == F.col("_cls"), "left")
    else:
        rows = rows.withColumn("cap_used", F.lit(0).cast("long"))
    collides = F.lit(False)
    for c in known:
        collides |= F.col(f"_{c}") != F.col(c)
    rev = class_map.reversibility(F.col("cls"), F.col("table"), F.col("op"))
    declared = F.coalesce(F.col("declared_reversibility"), F.lit(""))
    mismatch = ((declared != "") & (declared != rev)) | (F.col("exogenous") & F.col("has_inverse"))
    no_inverse = ~F.col("exogenous") & (rev == "reversible_by_inverse") & ~F.col("has_inverse")
    after = constraint_row(
        id=F.col("cell"), opened_ns=F.coalesce("_opened", "now_ns"), due_ns=F.col("due_ns"), pos_last=F.lit(0), src_pos_last=F.col("source_pos"), amount_minor=F.col("amount_minor"),
        cls=F.col("cls"), state=F.col("state"), flags=F.col("flags"), now_ns=F.col("now_ns"),
    )
    # Checks read the after-row by name; the fact's own columns of those names step aside for them.
    fact = F.struct(*[F.col(c).alias(c) for c in rows.columns])
    rows = rows.select(fact.alias("_f"), F.struct(collides.alias("collides"), mismatch.alias("mismatch"), no_inverse.alias("no_inverse")).alias("_t"), *after)
    rows = rows.withColumn("_check", class_map.check_failure(F.col("cls"))).select("_f", "_t", "_check")
    f = lambda c: F.col(f"_f.{c}")
    exists = f("_cell").isNotNull()
    dup = exists & (f("source_pos") == f("_last"))
    cap = class_map.cap(f("cls"))
    added = F.greatest(f("amount_minor") - F.coalesce(f("_amount"), F.lit(0)), F.lit(0).cast("long"))
    over = (cap >= 0) & (F.coalesce(f("cap_used"), F.lit(0)) + added > cap)
    early = (
        F.when((f("kind") == "verb") & ((F.lit(seam_hash) == "") | (f("by") != f"seam:{seam_hash}")), "not_authored_by_seam")
        .when(~class_map.known(f("cls")), "unknown_class")
        .when(exists & F.col("_t.collides"), "id_collision")
        .when(exists & (f("source_pos") < f("_last")), "stale_source")
    )
    late = F.when(F.col("_t.mismatch"), "reversibility_mismatch").when(F.col("_t.no_inverse"), "no_inverse").when(F.col("_check").isNotNull() | over, "constraint_violated")
    reason = F.coalesce(early, F.when(~dup, late))
    clause = F.when(reason == "constraint_violated", F.coalesce(F.col("_check"), F.concat(F.lit("cap:"), class_map.class_name(f("cls")))))
    return rows.select(*[f(c).alias(c) for c in facts.columns], (dup & early.isNull()).alias("dup"), reason.alias("reason"), clause.alias("constraint_id"))


def judged_requests(judged: DataFrame) -> DataFrame:
    """seq, reason, constraint_id of each request: those of its first refused fact."""
    bad = F.when(F.col("reason").isNotNull(), F.struct("idx", "reason", "constraint_id"))
    out = judged.groupBy("seq").agg(F.min(bad).alias("first"), F.count(F.lit(1)).alias("n_facts"))
    return out.select("seq", "n_facts", F.col("first.reason").alias("reason"), F.col("first.constraint_id").alias("constraint_id"))


def reasons(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.when(F.col("dup"), "dup"), F.lit("admitted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
