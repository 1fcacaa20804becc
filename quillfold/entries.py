"""Registered queries over the supplied tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quillfold.entries_ledger  # noqa: F401  registers its queries
from quillfold.functions.convert import cents, epoch_ns, minor_units, state_of, timestamp_ns
from quillfold.functions.expr import compile_text
from quillfold.functions.hashing import cell_id_column
from quillfold.functions.jsonlines import json_string
from quillfold.operators import admit, designed, enrich, field, grades, ordered, state
from quillfold.operators.enrich import EnrichedColumn, IngestDef, SideJoin
from quillfold.plans.tables import CELLS_SQL, FACTS_SQL, class_map, decision_log, facts, order_cells, table
from quillfold.registry import ORACLE_SQL, QUERIES, query
from quillfold.schema import INT64_MAX, INT64_MIN

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


# -- declared enrichment

ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def order_ingest(spark: SparkSession, sf_dir: str, *reducers: str) -> DataFrame:
    ingest = IngestDef(
        "orders",
        "o_orderkey",
        (
            EnrichedColumn("due_ns", "orders.o_orderdate"),
            EnrichedColumn("state", "orders.o_orderstatus"),
            *(EnrichedColumn(f"{r}_minor", "lineitem.l_extendedprice", r) for r in reducers),
        ),
        (SideJoin("lineitem", "l_orderkey", "orders", "o_orderkey"),),
    )
    to_long = {"due_ns": timestamp_ns, "state": lambda s: state_of(s, {"F": "closed", "O": "open", "P": "dispatched"}).cast("long"), **{f"{r}_minor": cents for r in reducers}}
    frame = enrich.compile_ingest(ingest, {n: table(spark, sf_dir, n) for n in ("orders", "lineitem")}, to_long, {"lineitem": ITEM_ORDER}).frame
    return frame.select("o_orderkey", "due_ns", "state", *[f"{r}_minor" for r in reducers], "n_lineitem")


_GRAIN = """o_orderkey, CAST(epoch_us(o_orderdate) * 1000 AS BIGINT) AS due_ns, CAST(CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'P' THEN 2 ELSE 0 END AS BIGINT) AS state"""
_SIDE = """SELECT {grain}, {columns}, coalesce(n, 0) AS n_lineitem FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, {aggregates} FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""
_MINOR = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_ROW = "{" + ", ".join(f"'c{i}': {c}" for i, c in enumerate(ITEM_ORDER)) + "}"


def _side_sql(**aggregates: str) -> str:
    return _SIDE.format(grain=_GRAIN, columns=", ".join(f"coalesce({k}, 0) AS {k}" for k in aggregates), aggregates=", ".join(f"{v} AS {k}" for k, v in aggregates.items()))


@query(_side_sql(sum_minor=f"CAST(sum({_MINOR}) AS BIGINT)"))
def enrich_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_ingest(spark, sf_dir, "sum")


@query(_side_sql(min_minor=f"min({_MINOR})", max_minor=f"max({_MINOR})"))
def enrich_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_ingest(spark, sf_dir, "min", "max")


@query(_side_sql(first_minor=f"arg_min({_MINOR}, {_ROW})", last_minor=f"arg_max({_MINOR}, {_ROW})"))
def enrich_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_ingest(spark, sf_dir, "first", "last")


@query(_side_sql(count_minor="count(*)", distinct_count_minor="count(DISTINCT l_extendedprice)"))
def enrich_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_ingest(spark, sf_dir, "count", "distinct_count")


@query(f"""
WITH s AS (SELECT o_orderkey, coalesce(sum({_MINOR}), 0) AS a, coalesce(arg_max({_MINOR}, {_ROW}), 0) AS b FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT o_orderkey FROM s WHERE a <> b""")
def enrich_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at which the sum and the last item disagree: what a wrong reducer would lose."""
    one = order_ingest(spark, sf_dir, "sum").withColumnRenamed("sum_minor", "amount")
    other = order_ingest(spark, sf_dir, "last").withColumnRenamed("last_minor", "amount")
    return enrich.disagreements(one, other, "o_orderkey", ["amount"])


@query("""
WITH t AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem), n AS (SELECT count(*) AS n FROM t),
r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM t)
SELECT p::DOUBLE AS percent, v AS value FROM n, (VALUES (0.0), (0.5), (0.95), (0.99), (1.0)) AS p(p), r WHERE i = CAST(floor(p * (n - 1) + 0.5) AS BIGINT)""")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(cents(F.col("l_extendedprice")).alias("v"))
    return enrich.nearest_rank(rows, "v", [0.0, 0.5, 0.95, 0.99, 1.0])


@query(r"""
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN c_acctbal::DECIMAL(12,2)::VARCHAR || '4' ELSE c_acctbal::DECIMAL(12,2)::VARCHAR END AS money FROM customer)
SELECT c_custkey, CASE WHEN money = '' THEN 0 WHEN regexp_matches(money, '^-?[0-9]{1,16}(\.[0-9]{0,2})?$') THEN CAST(money::DECIMAL(20,2) * 100 AS BIGINT) END AS minor FROM t""")
def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal text to minor units: empty is 0, a third decimal is refused."""
    text = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    text = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 11 == 0, F.concat(text, F.lit("4"))).otherwise(text)
    return table(spark, sf_dir, "customer").select("c_custkey", minor_units(text).alias("minor"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(epoch_us(date_trunc('second', o_orderdate)) * 1000 AS BIGINT) END AS ns FROM orders""")
def civil_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Civil time text to nanoseconds: empty is 0, short text is refused."""
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, F.substring(text, 1, 10)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", epoch_ns(text).alias("ns"))


# -- facts, cells, exposure


@query(f"WITH {FACTS_SQL} SELECT pos, cell, source_pos, verdict FROM v")
def fact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.admitted(facts(spark, sf_dir)).select("pos", "cell", "source_pos", "verdict")


@query(f"WITH {FACTS_SQL} SELECT cell, cls, amount_minor, due_ns, state, CAST(flags AS BIGINT) AS flags, src_pos_last, opened_ns, pos_last, n_applied FROM c")
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cells_of(state.admitted(facts(spark, sf_dir))).withColumns({c: F.col(c).cast("long") for c in ("state", "flags")})


_MIDDLE_SQL = "(SELECT coalesce((max(event_id) + 1) // 2, 0) FROM events)"


def _middle(f: DataFrame, part: int = 2) -> int:
    """A position that grows with the table."""
    return (f.agg(F.max("pos")).first()[0] or 0) // part


@query(f"WITH {FACTS_SQL.replace('FROM events', f'FROM events WHERE event_id < {_MIDDLE_SQL}')} SELECT cell, amount_minor, pos_last FROM c")
def cells_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state as of the middle of the log: a filter below the fold."""
    f = facts(spark, sf_dir)
    return state.cells_of(state.admitted(state.as_of(f, _middle(f)))).select("cell", "amount_minor", "pos_last")


@query(f"""
WITH {FACTS_SQL}, r AS (SELECT *, CASE WHEN lag(source_pos) OVER (PARTITION BY cell ORDER BY pos, idx) = source_pos THEN 'dup' ELSE 'applied' END AS rv FROM f)
SELECT cell, arg_max(amount_minor, CASE WHEN rv = 'applied' THEN pos END) AS amount_minor, max(pos) AS pos_last FROM r GROUP BY cell""")
def cells_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of a ledger whose facts all stand, delivered twice in part."""
    f = facts(spark, sf_dir)
    twice = f.unionByName(f.where("pos % 10 = 0"))
    return state.cells_of(state.replayed(state.delivered_once(twice))).select("cell", "amount_minor", "pos_last")


@query(f"""
WITH {FACTS_SQL}, i AS (SELECT pos, cls, greatest(amount_minor - coalesce(lag(amount_minor) OVER (PARTITION BY cell ORDER BY pos, idx), 0), 0) AS inc FROM v WHERE verdict = 'applied')
SELECT cls, CAST(sum(inc) AS BIGINT) AS cap_used FROM i WHERE pos > (SELECT (max(event_id) + 1) // 4 FROM events) GROUP BY cls""")
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure by class since a cap period tick after the first quarter of the log."""
    f = facts(spark, sf_dir)
    return state.caps_of(state.admitted(f), _middle(f, 4))


@query(f"WITH {FACTS_SQL} SELECT verdict, tbl AS \"table\", count(*) AS n FROM v GROUP BY ALL")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.admitted(facts(spark, sf_dir)).groupBy("verdict", "table").agg(F.count(F.lit(1)).alias("n"))


# -- constraint language and rules

CONSTRAINTS = {
    "plain": "amount_minor % 7 == 2 || state < 3",
    "guarded": "state == 0 || 100 / state >= 25",
    "unguarded": "100 / state >= 25",
    "overflow": "amount_minor * 922337203685477 > 0",
    "either": "amount_minor * 922337203685477 > 0 || true",
    "skipped": "false && 1 / state == 1",
    "minmax": "max(abs(-amount_minor), 5000) - min(amount_minor, 100) <= 20000",
    "signs": "!!(--amount_minor == ---cls + 4 || !!!(state > 1))",
    "nested": "(" * 64 + "state > 1" + ")" * 64,
}
_CHECK_SQL = {
    "plain": ("amount_minor % 7 = 2 OR state < 3", "NULL"),
    "guarded": ("CASE WHEN state = 0 THEN true ELSE 100 // state >= 25 END", "NULL"),
    "unguarded": ("CASE WHEN state = 0 THEN NULL ELSE 100 // nullif(state, 0) >= 25 END", "CASE WHEN state = 0 THEN 'expr_div_by_zero' END"),
    "overflow": ("CASE WHEN amount_minor::HUGEINT * 922337203685477 BETWEEN -9223372036854775808 AND 9223372036854775807 THEN amount_minor > 0 END", "CASE WHEN amount_minor::HUGEINT * 922337203685477 NOT BETWEEN -9223372036854775808 AND 9223372036854775807 THEN 'expr_overflow' END"),
    "either": ("CASE WHEN amount_minor::HUGEINT * 922337203685477 BETWEEN -9223372036854775808 AND 9223372036854775807 THEN true END", "CASE WHEN amount_minor::HUGEINT * 922337203685477 NOT BETWEEN -9223372036854775808 AND 9223372036854775807 THEN 'expr_overflow' END"),
    "skipped": ("false", "NULL"),
    "minmax": ("greatest(abs(amount_minor), 5000) - least(amount_minor, 100) <= 20000", "NULL"),
    "signs": ("amount_minor = 4 - cls OR NOT state > 1", "NULL"),
    "nested": ("state > 1", "NULL"),
}


@query(f"WITH {FACTS_SQL} SELECT pos, " + ", ".join(f"{v} AS {k}, CAST({e} AS VARCHAR) AS {k}_error" for k, (v, e) in _CHECK_SQL.items()) + " FROM f")
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint texts compiled to columns: verdicts and named errors."""
    rows = facts(spark, sf_dir)
    columns = []
    for name, text in CONSTRAINTS.items():
        value, error = compile_text(text).columns()
        columns += [value.alias(name), error.alias(f"{name}_error")]
    return rows.select("pos", *columns)


_REVERSIBILITY = """CASE cls
  WHEN 1 THEN CASE WHEN op = 'insert' THEN 'irreversible' ELSE 'reversible_by_inverse' END
  WHEN 2 THEN CASE WHEN tbl = 'error' THEN 'reversible_within' WHEN op = 'update' THEN 'reversible_by_inverse' ELSE 'irreversible' END
  WHEN 3 THEN CASE WHEN tbl = 'purchase' AND op = 'update' THEN 'reversible_by_inverse' ELSE 'irreversible' END
  ELSE 'irreversible' END"""


@query(f"WITH {FACTS_SQL} SELECT pos, {_REVERSIBILITY} AS reversibility FROM f")
def reversibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = class_map()
    return facts(spark, sf_dir).select("pos", classes.reversibility(F.col("cls"), F.col("table"), F.col("op")).alias("reversibility"))


def _proposals(spark: SparkSession, sf_dir: str, after: int) -> DataFrame:
    f = facts(spark, sf_dir).where(F.col("pos") > after)
    return f.select(
        F.col("pos").alias("seq"), "idx", F.when(F.col("pos") % 50 == 0, "verb").otherwise("tx").alias("kind"),
        F.when(F.col("pos") % 100 == 0, "seam:s1").otherwise("seat:a").alias("by"),
        "cell", F.lit("events").alias("source"), "table", F.col("cell").cast("string").alias("key"), "op", "cls", "source_pos", "amount_minor", "due_ns",
        "state", "flags", "exogenous", "has_inverse", F.when(F.col("pos") % 9 == 0, "irreversible").otherwise("").alias("declared_reversibility"), F.col("t_epoch_ns").alias("now_ns"),
    )


_JUDGED_SQL = f"""
WITH {FACTS_SQL.replace('FROM events', f'FROM events WHERE event_id < {_MIDDLE_SQL}')},
u AS (SELECT cls, CAST(sum(inc) AS BIGINT) AS cap_used FROM (SELECT cls, greatest(amount_minor - coalesce(lag(amount_minor) OVER (PARTITION BY cell ORDER BY pos, idx), 0), 0) AS inc FROM v WHERE verdict = 'applied') GROUP BY cls),
{FACTS_SQL.split("v AS (")[0].replace("f AS (", "a AS (", 1).rstrip().rstrip(',')},
p AS (
  SELECT a.*, {_REVERSIBILITY.replace('tbl', 'a.tbl').replace(' op ', ' a.op ').replace('CASE cls', 'CASE a.cls')} AS rev, CASE WHEN a.pos % 9 = 0 THEN 'irreversible' ELSE '' END AS declared,
    c.cell IS NOT NULL AS found, c.amount_minor AS before, c.src_pos_last AS last, coalesce(u.cap_used, 0) AS used
  FROM a LEFT JOIN c ON a.cell = c.cell LEFT JOIN u ON a.cls = u.cls WHERE a.pos > {_MIDDLE_SQL}),
q AS (
  SELECT *, CASE cls
    WHEN 1 THEN CASE WHEN NOT amount_minor <= 20000 THEN 'small' WHEN state = 0 THEN 'ratio:expr_div_by_zero' WHEN NOT (1000 // nullif(state, 0) >= 250 OR amount_minor < 5000) THEN 'ratio' END
    WHEN 2 THEN CASE WHEN NOT (due_ns = 0 OR due_ns >= t_epoch_ns) THEN 'due' END
    WHEN 3 THEN CASE WHEN least(amount_minor, 100)::HUGEINT * 92233720368547758 NOT BETWEEN -9223372036854775808 AND 9223372036854775807 THEN 'wide:expr_overflow' WHEN NOT least(amount_minor, 100) > 0 THEN 'wide' END
    WHEN 5 THEN CASE WHEN state = 2 THEN 'mod:expr_div_by_zero' WHEN NOT (amount_minor % nullif(state - 2, 0) = 0 AND NOT flags > 0) THEN 'mod' END
    END AS chk,
    cls = 3 AND used + greatest(amount_minor - coalesce(before, 0), 0) > 25000 AS over
  FROM p),
j AS (
  SELECT *, found AND source_pos = last AS same,
    CASE WHEN pos % 50 = 0 AND NOT pos % 100 = 0 THEN 'not_authored_by_seam' WHEN cls NOT IN (1, 2, 3, 5) THEN 'unknown_class' WHEN found AND source_pos < last THEN 'stale_source' END AS early,
    CASE WHEN (declared <> '' AND declared <> rev) OR (exogenous AND has_inverse) THEN 'reversibility_mismatch' WHEN NOT exogenous AND rev = 'reversible_by_inverse' AND NOT has_inverse THEN 'no_inverse'
      WHEN chk IS NOT NULL OR over THEN 'constraint_violated' END AS late
  FROM q),
o AS (SELECT pos, coalesce(same, false) AND early IS NULL AS dup, coalesce(early, CASE WHEN NOT coalesce(same, false) THEN late END) AS reason, chk FROM j)
"""


def _judged_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    middle = _middle(f)
    base = state.admitted(state.as_of(f, middle))
    return admit.judged_facts(_proposals(spark, sf_dir, middle), state.cells_of(base), class_map(), state.caps_of(base), "s1")


@query(_JUDGED_SQL + "SELECT pos AS seq, dup, reason, CASE WHEN reason = 'constraint_violated' THEN coalesce(chk, 'cap:purchase') END AS constraint_id FROM o")
def admission_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the events judged by the state that the earlier half left; both grow with the table."""
    return _judged_middle(spark, sf_dir).select("seq", "dup", "reason", "constraint_id")


@query(_JUDGED_SQL + "SELECT coalesce(reason, CASE WHEN dup THEN 'dup' END, 'admitted') AS outcome, count(*) AS n FROM o GROUP BY ALL")
def admission_middle_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit.reasons(_judged_middle(spark, sf_dir))


@query("SELECT event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id, event_id // 20 ORDER BY event_id) > 1 THEN 'duplicate_request' END AS fault FROM events")
def idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("client_id"), F.call_function("div", F.col("event_id"), F.lit(20)).alias("request_id"))
    return admit.first_requests(e).select("seq", "fault")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (
  SELECT user_id, event_id, t, rn, true AS admitted, 2.0::DOUBLE AS tokens FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.t, e.rn, least(3.0, b.tokens + (e.t - b.t) / 1e9 * 0.0001) >= 1,
    least(3.0, b.tokens + (e.t - b.t) / 1e9 * 0.0001) - CASE WHEN least(3.0, b.tokens + (e.t - b.t) / 1e9 * 0.0001) >= 1 THEN 1 ELSE 0 END
  FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1)
SELECT user_id, event_id, admitted FROM b""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", timestamp_ns(F.col("ts")).alias("t_ns"))
    return ordered.token_bucket(e, 0.0001, 3.0, "user_id", "t_ns", ["event_id"]).select("user_id", "event_id", "admitted")


@query("""
WITH RECURSIVE e AS (SELECT event_type, user_id % 10 AS who, event_id, epoch_us(ts) * 1000 AS t, row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id) AS rn FROM events),
w AS (
  SELECT event_type, who, rn, t AS opened, rn AS opener FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_type, e.who, e.rn, CASE WHEN e.t - w.opened <= 7200000000000 THEN w.opened ELSE e.t END, CASE WHEN e.t - w.opened <= 7200000000000 THEN w.opener ELSE e.rn END
  FROM w JOIN e ON e.event_type = w.event_type AND e.who = w.who AND e.rn = w.rn + 1)
SELECT event_type AS reason, who AS cell, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq, CASE WHEN w.rn = w.opener THEN 'opener' ELSE 'pending' END AS role
FROM w JOIN e USING (event_type, who, rn) GROUP BY event_type, who, opener, role""")
def refusal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals coalesced in windows that their first one opens."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("reason"), (F.col("user_id") % 10).alias("cell"), F.col("event_id").alias("seq"), timestamp_ns(F.col("ts")).alias("now_ns"))
    return ordered.coalesced_refusals(e, 7_200_000_000_000, ["reason", "cell"])


# -- the lattice

DIMS = field.Dims(4, 6, 8, 30 * 86_400 * 1_000_000_000)
NOW, LATER = 820_454_400_000_000_000, 830_000_000_000_000_000
_SLOT = "CASE WHEN due_ns = 0 THEN 7 WHEN due_ns <= {now} THEN 0 ELSE least((due_ns - {now}) // 2592000000000000, 7) END"
_PLACED = CELLS_SQL + ",\nl AS (SELECT *, CAST(seg % 4 AS INT) AS fs, CAST(cls % 6 AS INT) AS fc, " + _SLOT.format(now=NOW) + " AS slot, " + _SLOT.format(now=LATER) + " AS slot2 FROM k WHERE state <= 2)"


@query(f"""
WITH {_PLACED}, g AS (SELECT fs, fc, slot, CAST(sum(amount_minor) * 65536 AS BIGINT) AS load, count(*) * 65536 AS n, CAST(sum(flags) AS BIGINT) AS w FROM l GROUP BY ALL)
SELECT CAST(s AS INT) AS seg, CAST(c AS INT) AS cls, CAST(t AS INT) AS slot, coalesce(load, 0) AS load, coalesce(n, 0) AS "count", coalesce(w, 0) AS warrants
FROM range(4) a(s), range(6) b(c), range(8) d(t) LEFT JOIN g ON fs = s AND fc = c AND slot = t""")
def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.dense(field.projection(order_cells(spark, sf_dir), NOW, DIMS), DIMS)


@query(f"""
WITH {_PLACED} SELECT fs AS seg, fc AS cls, CAST(slot2 AS INT) AS slot, CAST(sum(amount_minor) * 65536 AS BIGINT) AS load, count(*) * 65536 AS "count", CAST(sum(flags) AS BIGINT) AS warrants FROM l GROUP BY ALL""")
def lattice_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice at a later instant, as the earlier one plus what the moved cells take away and bring."""
    cells_ = order_cells(spark, sf_dir)
    crossing = field.moved(cells_, NOW, LATER, DIMS).select(cells_.columns)
    changes = field.merged(field.projection(crossing, NOW, DIMS, -1), field.projection(crossing, LATER, DIMS))
    return field.merged(field.projection(cells_, NOW, DIMS), changes).where("count <> 0")


@query(f"WITH {_PLACED} SELECT cell, CAST(slot AS INT) AS f_slot, CAST(slot2 AS INT) AS new_slot, CASE WHEN due_ns <> 0 AND slot > 0 THEN due_ns - slot * 2592000000000000 + 1 END AS crossing_ns FROM l WHERE slot <> slot2")
def lattice_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = field.moved(order_cells(spark, sf_dir), NOW, LATER, DIMS)
    return rows.select("cell", "f_slot", "new_slot", field.crossing_ns(F.col("due_ns"), F.col("f_slot"), DIMS).alias("crossing_ns"))


@query(f"WITH {_PLACED} SELECT fs AS seg, fc AS cls, CAST(count(DISTINCT slot) AS BIGINT) AS slots_in_use, CAST(8 AS BIGINT) AS slots, count(*) AS cells FROM l GROUP BY ALL")
def lattice_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bucket is there, used or not, and every cell in one."""
    rows = field.dense(field.projection(order_cells(spark, sf_dir), NOW, DIMS), DIMS)
    return rows.groupBy("seg", "cls").agg(F.count_if(F.col("count") > 0).alias("slots_in_use"), F.count(F.lit(1)).alias("slots"), F.call_function("div", F.sum("count"), F.lit(65536)).alias("cells")).where("cells > 0")


@query(f"""
WITH {_PLACED}, g AS (SELECT fs, fc, slot, CAST(sum(amount_minor) * 65536 AS BIGINT) AS load FROM l GROUP BY ALL)
SELECT (SELECT CAST(sum(amount_minor) * 65536 AS BIGINT) FROM k WHERE state <= 2) AS table_fix, CAST(sum(load) AS BIGINT) AS lattice_fix FROM g""")
def lattice_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both totals, exact: longs as in the SQL, or decimals if one leaves 64 bits, where the SQL has no result."""
    cells_ = order_cells(spark, sf_dir)
    totals = field.conservation(cells_, field.projection(cells_, NOW, DIMS))
    kind, number = ("long", int) if all(INT64_MIN <= x <= INT64_MAX for x in totals) else ("decimal(38,0)", Decimal)
    return spark.createDataFrame([tuple(map(number, totals))], f"table_fix {kind}, lattice_fix {kind}")


@query(f"""
WITH {_PLACED}, g AS (SELECT fs, fc, slot, CAST(sum(amount_minor) * 65536 AS BIGINT) AS load FROM l GROUP BY ALL), d AS (SELECT *, load // 7 - 1000000 AS baseline, 5000 - load // 11 AS dev FROM g)
SELECT fs AS seg, fc AS cls, CAST(slot AS INT) AS slot, baseline + (dev >> 6) AS baseline, dev - (dev >> 6) AS dev FROM d""")
def lattice_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick's step of the baseline."""
    rows = field.projection(order_cells(spark, sf_dir), NOW, DIMS)
    part = lambda n: F.call_function("div", F.col("load"), F.lit(n))
    rows = rows.select("seg", "cls", "slot", (part(7) - 1_000_000).alias("b"), (5000 - part(11)).alias("d"))
    baseline, dev = field.settled(F.col("b"), F.col("d"), 6)
    return rows.select("seg", "cls", "slot", baseline.alias("baseline"), dev.alias("dev"))


#: So mild that loads of any supplied table stay within 64 bits.
MILD = dict(den=16, omega=16, decay=16, k_cls=4, k_slot=4)


def _relaxed(colour: int, dev: str) -> str:
    """The list of a colour's steps, in SQL: buckets are numbered by segment, class and slot."""
    return f"""list_transform(range(192), lambda i: CASE WHEN (i // 8 % 6 + i % 8) % 2 = {colour} AND w[i + 1] = 0 THEN (
      16 * (load[i + 1]::HUGEINT * 16 - 16 * {dev}[i + 1]
        + 4 * (CASE WHEN i // 8 % 6 > 0 THEN {dev}[i - 7] - {dev}[i + 1] ELSE 0 END + CASE WHEN i // 8 % 6 < 5 THEN {dev}[i + 9] - {dev}[i + 1] ELSE 0 END
          + CASE WHEN i % 8 > 0 THEN {dev}[i] - {dev}[i + 1] ELSE 0 END + CASE WHEN i % 8 < 7 THEN {dev}[i + 2] - {dev}[i + 1] ELSE 0 END))
      // (16 * (16 + 4 * ((i // 8 % 6 > 0)::INT + (i // 8 % 6 < 5)::INT + (i % 8 > 0)::INT + (i % 8 < 7)::INT)))) ELSE 0 END)"""


_ADDED = "list_transform(list_zip({a}, {b}), lambda x: x[1] + x[2])"
_COEFFICIENTS = field.Coefficients(**MILD)


@query(f"""
WITH RECURSIVE {_PLACED}, g AS (SELECT fs, fc, slot, CAST(sum(amount_minor) * 65536 AS BIGINT) AS load, CAST(sum(flags) AS BIGINT) AS w FROM l GROUP BY ALL),
x AS (SELECT list(coalesce(load, 0) ORDER BY s, c, t) AS load, list(coalesce(w, 0) ORDER BY s, c, t) AS w FROM range(4) q(s), range(6) r(c), range(8) u(t) LEFT JOIN g ON fs = s AND fc = c AND slot = t),
r(n, dev, done) AS (
  SELECT 0, list_transform(range(192), lambda i: 0::HUGEINT), false
  UNION ALL
  SELECT n + 1, dev2, list_max(list_transform(list_concat(red, black), lambda v: abs(v))) <= greatest(list_max(list_transform(dev2, lambda v: abs(v))), 65536) // {_COEFFICIENTS.tol_den} * {_COEFFICIENTS.tol_num}
  FROM (SELECT *, {_ADDED.format(a="dev1", b="black")} AS dev2 FROM (SELECT *, {_relaxed(1, "dev1")} AS black FROM (
    SELECT *, {_ADDED.format(a="dev", b="red")} AS dev1 FROM (SELECT n, dev, load, w, {_relaxed(0, "dev")} AS red FROM r, x WHERE NOT done AND n < {_COEFFICIENTS.max_iters})))))
SELECT CAST(i // 48 AS INT) AS seg, CAST(i // 8 % 6 AS INT) AS cls, CAST(i % 8 AS INT) AS slot, CAST(dev[i + 1] AS BIGINT) AS dev, CAST(dev[i + 1] AS BIGINT) AS pressure, CAST(n AS BIGINT) AS iters, done AS converged
FROM range(192) y(i), (SELECT * FROM r ORDER BY n DESC LIMIT 1)""")
def lattice_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.swept(field.dense(field.projection(order_cells(spark, sf_dir), NOW, DIMS), DIMS), DIMS, field.Coefficients(**MILD))


@query(f"""
WITH {_PLACED}, g AS (SELECT fs, fc, slot, CAST(sum(amount_minor) * 65536 AS BIGINT) AS load, CAST(sum(flags) AS BIGINT) AS w FROM l GROUP BY ALL),
x AS (
  SELECT s, c, t, coalesce(load, 0) AS load, coalesce(w, 0) AS w, 16 + 4 * ((c > 0)::INT + (c < 5)::INT + (t > 0)::INT + (t < 7)::INT) AS diag
  FROM range(4) q(s), range(6) r(c), range(8) u(t) LEFT JOIN g ON fs = s AND fc = c AND slot = t),
e AS (SELECT *, CASE WHEN (c + t) % 2 = 0 AND w = 0 THEN 256 * load // (16 * diag) ELSE 0 END AS d0 FROM x),
n AS (SELECT e.s, e.c, e.t, CAST(sum(4 * o.d0) AS BIGINT) AS pull FROM e JOIN e o ON e.s = o.s AND abs(e.c - o.c) + abs(e.t - o.t) = 1 GROUP BY ALL)
SELECT CAST(e.s AS INT) AS seg, CAST(e.c AS INT) AS cls, CAST(e.t AS INT) AS slot, CASE WHEN (e.c + e.t) % 2 = 1 AND w = 0 THEN 16 * (16 * load + pull) // (16 * diag) ELSE d0 END AS dev
FROM e JOIN n ON e.s = n.s AND e.c = n.c AND e.t = n.t""")
def lattice_first_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One iteration: both colours once, from rest."""
    once = field.Coefficients(**MILD, max_iters=1)
    return field.swept(field.dense(field.projection(order_cells(spark, sf_dir), NOW, DIMS), DIMS), DIMS, once).select("seg", "cls", "slot", "dev")


# -- grades

HORIZONS = {0: grades.Horizons(*[x * 1_000_000_000 for x in (20_000, 40_000, 30_000, 10_000, 60_000, 9_000, 20_000)]), 1: grades.Horizons(*[x * 1_000_000_000 for x in (5_000, 9_000, 70_000, 20_000, 30_000, 4_000, 90_000)])}
_LOG_SQL = f"""
{FACTS_SQL},
g AS (
  SELECT pos - 1 AS seq, CASE WHEN cls = 4 THEN 'tick' WHEN cls = 3 THEN 'fact' WHEN cls = 2 AND pos % 4 = 0 THEN 'human' WHEN cls = 2 THEN 'judgment' ELSE 'verb' END AS k,
    pos, cell % 40 AS cell, cell % 3 AS cls, (pos - 1) % 5 AS verb, t_epoch_ns AS at_ns, CASE WHEN (pos - 1) % 2 = 0 THEN 0 ELSE t_epoch_ns + (pos - 1) % 7 * 600000000000 END AS due_ns,
    (pos - 1) % 3 AS cf, (pos - 1) % 4 AS source, (pos - 1) % 2 = 0 AS closed, (pos - 1) % 23 = 0 AS reworked, (pos - 1) % 31 = 0 AS reopened, (pos - 1) % 2 = 1 AS crossed, (pos - 1) % 13 = 0 AS cap_hit
  FROM f),
n AS (
  SELECT *, max(CASE WHEN k <> 'human' THEN at_ns END) OVER (ORDER BY seq) AS now, coalesce(last_value(CASE WHEN k = 'human' THEN verb END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS hv FROM g),
d AS (
  SELECT *, CASE WHEN cls = 2 THEN at_ns ELSE CASE verb
    WHEN 1 THEN at_ns + CASE cls WHEN 0 THEN 20000 ELSE 5000 END * 1000000000::BIGINT
    WHEN 2 THEN at_ns + CASE cls WHEN 0 THEN 40000 ELSE 9000 END * 1000000000::BIGINT
    WHEN 3 THEN at_ns + CASE cls WHEN 0 THEN 30000 ELSE 70000 END * 1000000000::BIGINT
    WHEN 0 THEN CASE WHEN due_ns <> 0 THEN due_ns + CASE cls WHEN 0 THEN 10000 ELSE 20000 END * 1000000000::BIGINT ELSE at_ns + CASE cls WHEN 0 THEN 60000 ELSE 30000 END * 1000000000::BIGINT END
    ELSE at_ns + CASE cls WHEN 0 THEN 29000 ELSE 94000 END * 1000000000::BIGINT END END AS hz
  FROM n WHERE k = 'verb'),
x AS (
  SELECT d.seq AS dseq, n.seq, CASE WHEN d.verb IN (1, 2) AND (n.reworked OR n.reopened OR d.pos = 0) THEN CASE WHEN n.at_ns <= hz THEN 'wrong' ELSE 'reversed_late' END
      WHEN d.verb IN (0, 1, 2) AND n.closed AND n.at_ns <= hz THEN 'right' WHEN d.verb = 4 AND n.at_ns <= hz THEN CASE WHEN n.hv = d.cf THEN 'wrong' ELSE 'right' END
      WHEN d.verb = 3 AND n.at_ns <= hz AND (SELECT arg_max(m.crossed, m.seq) FROM n m WHERE m.k = 'judgment' AND m.cell = d.cell AND m.seq > d.seq AND m.seq < n.seq) THEN 'right' END AS ver, n.at_ns AS ats
  FROM d JOIN n ON n.k = 'fact' AND n.cell = d.cell AND n.seq > d.seq
  UNION ALL
  SELECT d.seq, n.seq, CASE WHEN n.crossed AND NOT n.cap_hit THEN 'right' ELSE 'wrong' END, n.at_ns FROM d JOIN n ON n.k = 'judgment' AND n.cell = d.cell AND n.seq > d.seq AND d.verb = 3 AND n.at_ns <= hz
  UNION ALL
  SELECT dseq, seq, CASE WHEN verb IN (1, 2) THEN 'right' WHEN verb = 0 AND due_ns <> 0 AND due_ns <= now OR verb = 3 THEN 'wrong' ELSE 'ungradable' END, now
  FROM (SELECT d.seq AS dseq, d.verb, d.due_ns, t.seq, t.now FROM d JOIN n t ON t.k = 'tick' AND t.seq > d.seq AND t.now > d.hz QUALIFY row_number() OVER (PARTITION BY d.seq ORDER BY t.seq) = 1)),
y AS (SELECT dseq, arg_min(ver, seq) AS ver, arg_min(ats, seq) AS ats FROM x WHERE ver IS NOT NULL GROUP BY dseq),
z AS (SELECT d.seq, d.pos, d.cell, d.cls, CAST(d.verb AS BIGINT) AS verb, CAST(d.source AS BIGINT) AS source, d.hz AS horizon_ns, coalesce(ver, 'ungraded_yet') AS verdict, coalesce(ats, 0) AS graded_at_ns FROM d LEFT JOIN y ON d.seq = dseq)
"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades.decisions(decision_log(spark, sf_dir), HORIZONS, seq_block=1000)


@query(f"WITH {_LOG_SQL} SELECT * FROM z")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("verb", "source")})


_TALLY = ", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in grades.VERDICTS)


@query(f"WITH {_LOG_SQL} SELECT cls, verb, source, {_TALLY}, count(*) AS n, count(*) FILTER (verdict IN ('right', 'wrong', 'reversed_late')) AS n_graded FROM z GROUP BY ALL")
def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grades.tallies(_graded(spark, sf_dir), ("cls", "verb", "source"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("verb", "source")})


@query(f"""
WITH {_LOG_SQL}, t AS (SELECT cls, verb, count(*) FILTER (verdict IN ('right', 'wrong', 'reversed_late')) AS n FROM z GROUP BY ALL),
s AS (
  SELECT cls, avg(CASE WHEN verdict = 'ungradable' THEN 1.0 ELSE 0.0 END) AS fr, count(*) FILTER (source = 2 AND verb = 1 AND verdict IN ('right', 'wrong', 'reversed_late')) AS canary FROM z GROUP BY cls),
r AS (
  SELECT cls, CASE WHEN (SELECT min(verb) FROM (SELECT v.verb FROM range(5) v(verb) LEFT JOIN t ON t.cls = s.cls AND t.verb = v.verb WHERE coalesce(n, 0) < 20)) IS NOT NULL
      THEN 'verb ' || (SELECT min(verb) FROM (SELECT v.verb FROM range(5) v(verb) LEFT JOIN t ON t.cls = s.cls AND t.verb = v.verb WHERE coalesce(n, 0) < 20))
    WHEN canary < 20 THEN 'canary' WHEN fr > 0.1 THEN 'ungradable_fraction' END AS reason FROM s)
SELECT cls, reason IS NULL AS calibrated, reason FROM r""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades.calibration(_graded(spark, sf_dir), range(5), 20, 0.1)


# -- designed folds


@query(f"""
WITH {_LOG_SQL}, t AS (SELECT cls, verb, count(*) FILTER (verdict IN ('right', 'wrong', 'reversed_late')) AS g, count(*) FILTER (verdict IN ('wrong', 'reversed_late')) AS b FROM z GROUP BY ALL)
SELECT cls, 0.4::DOUBLE AS ceiling, min(g) AS n_eff, round(max(CASE WHEN g > 0 THEN b / g END), 9) AS worst_rate, min(g) >= 10 AND max(CASE WHEN g > 0 THEN b / g END) <= 0.4 AS licensed FROM t GROUP BY cls""")
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ceilings = spark.createDataFrame([(c, x) for c in range(3) for x in (0.5, 0.4)], "cls long, ceiling double")
    return designed.licences(grades.tallies(_graded(spark, sf_dir)), ceilings, 10).withColumn("worst_rate", F.round("worst_rate", 9))


@query(f"""
WITH {FACTS_SQL}, e AS (SELECT cls, pos AS seq, CASE WHEN state = 0 THEN 1 ELSE 0 END AS created, CASE WHEN state = 4 THEN 1 ELSE 0 END AS removed_confirmed FROM f)
SELECT cls, seq, CAST(sum(created) OVER w AS BIGINT) AS created, CAST(sum(removed_confirmed) OVER w AS BIGINT) AS removed, round(sum(created) OVER w / nullif(sum(removed_confirmed) OVER w, 0), 9) AS kappa
FROM e WINDOW w AS (PARTITION BY cls ORDER BY seq RANGE BETWEEN 500 PRECEDING AND CURRENT ROW)""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts(spark, sf_dir).select("cls", F.col("pos").alias("seq"), (F.col("state") == 0).cast("long").alias("created"), (F.col("state") == 4).cast("long").alias("removed_confirmed"))
    return designed.kappa(e, 500).withColumn("kappa", F.round("kappa", 9))


@query("""
WITH a AS (SELECT o_orderkey AS ask_id, year(o_orderdate) * 12 + month(o_orderdate) AS period, o_orderkey % 5 = 0 AS pool, CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_custkey AS cost FROM orders)
SELECT ask_id, spent, spent <= 20000 AS granted FROM (SELECT *, CAST(sum(cost) OVER (PARTITION BY period, pool ORDER BY value DESC, ask_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM a)""")
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    asks = o.select(F.col("o_orderkey").alias("ask_id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), (F.col("o_orderkey") % 5 == 0).alias("pool"), cents(F.col("o_totalprice")).alias("value"), F.col("o_custkey").alias("cost"), F.lit(20_000).alias("budget"))
    return designed.allocated(asks).select("ask_id", "spent", "granted")


@query("""
WITH v AS (SELECT l_orderkey AS decision, l_linenumber AS judge, l_linenumber % 3 AS base, max(l_returnflag) AS verdict FROM lineitem GROUP BY ALL)
SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS n, round(avg(CASE WHEN a.verdict <> b.verdict THEN 1.0 ELSE 0.0 END), 9) AS disagreement
FROM v a JOIN v b USING (decision) WHERE a.judge < b.judge AND a.base <> b.base GROUP BY ALL""")
def independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("decision"), F.col("l_linenumber").alias("judge"), (F.col("l_linenumber") % 3).alias("base")).agg(F.max("l_returnflag").alias("verdict"))
    return designed.independence(v).withColumn("disagreement", F.round("disagreement", 9))


@query("SELECT o_orderkey AS idem_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without an item, as intents without a result."""
    return designed.outbox(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idem_key")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idem_key")))


@query("SELECT l_orderkey AS cell, l_suppkey * 3 AS blocked_by FROM lineitem WHERE l_suppkey * 3 NOT IN (SELECT s_suppkey FROM supplier)")
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_suppkey") * 3).alias("blocked_by"))
    return designed.dangling(rows, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell")))


@query("""
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, round(list_cosine_similarity(q.e, r.e), 12) AS s FROM q, r WHERE q.vec_id <> r.vec_id)
SELECT query_id, neighbour_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS rank FROM s) WHERE rank <= 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every twentieth vector among all."""
    v = table(spark, sf_dir, "embeddings")
    return designed.nearest(v, v.where("vec_id % 20 = 0"))


# -- text and codecs

_ESCAPED = "replace(text, chr(92), chr(92) || chr(92))"
for _code, _out in [(c, {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(c, f"\\u{c:04x}")) for c in range(1, 32)] + [(34, '\\"'), (127, "\\u007f")]:
    _ESCAPED = f"replace({_ESCAPED}, chr({_code}), '{_out}')"


@query(f"""SELECT doc_id, md5('"' || {_ESCAPED} || '"') AS literal_md5, CAST(length({_ESCAPED}) + 2 AS BIGINT) AS literal_length FROM documents""")
def json_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as string literals of the ledger."""
    literal = json_string(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(literal).alias("literal_md5"), F.length(literal).cast("long").alias("literal_length"))


@query("SELECT doc_id, md5(to_base64(encode(text))) AS b64_md5, CAST(length(to_base64(encode(text))) AS BIGINT) AS b64_length FROM documents")
def text_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as base64, by digest and length."""
    b64 = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\r\n", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(b64).alias("b64_md5"), F.length(b64).cast("long").alias("b64_length"))


@query("SELECT count(DISTINCT (event_type, user_id)) AS n_cells, count(*) AS n FROM events")
def cell_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell ids by hash: as many as there are keys."""
    e = table(spark, sf_dir, "events")
    ids = e.select(cell_id_column(F.lit("events"), F.col("event_type"), F.col("user_id").cast("string")).alias("cell"))
    return ids.agg(F.count_distinct("cell").alias("n_cells"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def props_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a body's text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_sum(spark, sf_dir)
