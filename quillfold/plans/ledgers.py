"""The supplied events as many ledgers: rows of one stretch of events are chained by one task, stretches side by side.

What the lines hold is what a writer would have written; ``scan_lines`` reads them as it reads segments. The damages are
for checks: each is decided by an event's number, so SQL can tell what a scan or a verification must find.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions.jsonlines import Members, dumps, json_string
from quillfold.plans.tables import facts, table
from quillfold.schema import GENESIS, REFUSALS
from quillfold.sources.writer import build_row

#: Events of a ledger, and of a segment; the clock.
STRETCH, SEGMENT = 5000, 1000
START_NS, STEP_NS = 1_757_000_000_000_000_000, 1_000_000
LINES = "ledger long, event long, seg_first_pos long, line_no long, line binary, whole boolean"


def tx_body(ledger: Column) -> Column:
    """The body of a write in the writer's order of fields, from the columns of ``facts``."""
    q = lambda c: json_string(c.cast("string"))
    n = lambda name: F.col(name).cast("string")
    flag = lambda name: F.when(F.col(name), "true").otherwise("false")
    text = lambda x: F.lit(x)
    fact = F.concat(
        text('{"source":'), q(F.concat(F.lit("events-"), ledger.cast("string"))), text(',"table":'), q(F.col("table")), text(',"key":'), q(F.col("cell")), text(',"op":'), q(F.col("op")),
        text(',"source_pos":'), n("source_pos"), text(',"cls":'), n("cls"), text(',"exogenous":'), flag("exogenous"), text(',"has_inverse":'), flag("has_inverse"), text(',"reverses_pos":0,"after":{"amount_minor":'),
        n("amount_minor"), text(',"due_ns":'), n("due_ns"), text(',"state":'), n("state"), text(',"flags":'), n("flags"), text("}}"),
    )
    return F.concat(text('{"client_id":"c'), n("cell"), text('","request_id":"r'), n("pos"), text('","basis_pos":'), (F.col("pos") % 97).cast("string"), text(',"reversibility":"","facts":['), fact, text("]}"))


def tick_body() -> Column:
    return F.concat(F.lit('{"cadence_rule":"'), F.when(F.col("pos") % 2 == 0, "cap_period").otherwise("decay"), F.lit('","deadline_wheel_pos":'), F.col("cell").cast("string"), F.lit("}"))


def refuse_body() -> Column:
    reason = F.element_at(F.array(*[F.lit(r) for r in REFUSALS]), (F.col("pos") % len(REFUSALS) + 1).cast("int"))
    return F.concat(F.lit('{"attempted_digest":"'), F.md5(F.col("pos").cast("string").cast("binary")), F.lit('","reason":"'), reason, F.lit('","constraint_id":"","count":'), (F.col("pos") % 5 + 1).cast("string"), F.lit(',"first_pos":'), F.col("pos").cast("string"), F.lit(',"last_pos":'), F.col("pos").cast("string"), F.lit("}"))


#: The same in SQL: u has a row for each event with its ledger, its place there (i), kind, body and header.
EVENTS_SQL = f"""
u AS (
  SELECT *, pos AS event, (pos - 1) // {STRETCH} AS ledger, row_number() OVER (PARTITION BY (pos - 1) // {STRETCH} ORDER BY pos) - 1 AS i,
    CASE tbl WHEN 'signup' THEN 'tick' WHEN 'error' THEN 'refuse' ELSE 'tx' END AS k, 'seat:' || (cell % 7) AS author,
    CASE tbl WHEN 'signup' THEN '{{"cadence_rule":"' || CASE WHEN pos % 2 = 0 THEN 'cap_period' ELSE 'decay' END || '","deadline_wheel_pos":' || cell || '}}'
      WHEN 'error' THEN '{{"attempted_digest":"' || md5(pos::VARCHAR) || '","reason":"' || {list(REFUSALS)}[pos % {len(REFUSALS)} + 1] || '","constraint_id":"","count":' || (pos % 5 + 1) || ',"first_pos":' || pos || ',"last_pos":' || pos || '}}'
      ELSE '{{"client_id":"c' || cell || '","request_id":"r' || pos || '","basis_pos":' || (pos % 97) || ',"reversibility":"","facts":[{{"source":"events-' || ((pos - 1) // {STRETCH}) || '","table":"' || tbl || '","key":"' || cell || '","op":"' || op
        || '","source_pos":' || source_pos || ',"cls":' || cls || ',"exogenous":' || exogenous || ',"has_inverse":' || has_inverse || ',"reverses_pos":0,"after":{{"amount_minor":' || amount_minor || ',"due_ns":' || due_ns || ',"state":' || state || ',"flags":' || flags || '}}}}]}}' END AS body
  FROM f),
w AS (SELECT *, i + i // {SEGMENT} + 1 AS place, i // {SEGMENT} * ({SEGMENT} + 1) AS seg, i % {SEGMENT} + 2 AS line_no FROM u),
h AS (SELECT DISTINCT ledger, seg, i // {SEGMENT} AS part FROM w)"""


def event_lines(spark: SparkSession, sf_dir: str, late: Callable[[int], bool] | None = None) -> DataFrame:
    """Ledgers of the events: ``LINES``, whose event is null for the first row of a segment. An event that is ``late`` has the stamp of the row before it."""
    ledger = F.call_function("div", F.col("pos") - 1, F.lit(STRETCH))
    kind = F.expr("CASE `table` WHEN 'signup' THEN 'tick' WHEN 'error' THEN 'refuse' ELSE 'tx' END")
    body = F.when(kind == "tick", tick_body()).when(kind == "refuse", refuse_body()).otherwise(tx_body(ledger))
    rows = facts(spark, sf_dir).select(ledger.alias("ledger"), F.col("pos").alias("event"), kind.alias("k"), "cell", "cls", F.concat(F.lit("seat:"), (F.col("cell") % 7).cast("string")).alias("author"), body.cast("binary").alias("body"))

    def chained(of: pa.Table) -> pa.Table:
        of = of.sort_by("event")
        out, prev, pos, seg = [], GENESIS, 0, 0
        ledger = of.column("ledger")[0].as_py()
        for i, (event, k, cell, cls, author, body) in enumerate(zip(*(of.column(c).to_pylist() for c in ("event", "k", "cell", "cls", "author", "body")), strict=True)):
            if i % SEGMENT == 0:
                seg, number = pos, 1
                line, prev = build_row(pos, START_NS + pos * STEP_NS, "seg", 0, 0, "system", dumps(Members([("first_pos", pos), ("prev_of_first_entry", prev)])), prev)
                out.append((ledger, None, seg, number, line[:-1], True))
                pos += 1
            stamp = START_NS + (pos - 1 if late is not None and late(event) else pos) * STEP_NS
            line, prev = build_row(pos, stamp, k, cell, cls, author, body, prev)
            number += 1
            out.append((ledger, event, seg, number, line[:-1], True))
            pos += 1
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in LINES.split(", ")])

    return rows.groupBy("ledger").applyInArrow(chained, LINES)


def _swap(line: bytes, old: bytes, new: bytes, last: bool = False) -> bytes:
    at = line.rfind(old) if last else line.find(old)
    return line[:at] + new + line[at + len(old) :]


def _moved(line: bytes, at: int, byte: bytes) -> bytes:
    at %= len(line)
    return line[:at] + byte + line[at + 1 :]


#: One for each reason of a scan, in the order of its checks.
DAMAGES: list[Callable[[bytes], bytes]] = [
    lambda x: _swap(x, b',"prev":"', b',"perv":"', True),
    lambda x: x + b" ",
    lambda x: _moved(x, -137, b"g"),
    lambda x: _swap(x, b'","h":"', b'","H":"', True),
    lambda x: _moved(x, -66, b"z"),
    lambda x: x[:-1] + b"]",
    lambda x: _swap(x, b'{"pos":', b'{"Pos":'),
    lambda x: _swap(x, b'{"pos":', b'{"pos":0'),
    lambda x: _swap(x, b',"term":', b',"Term":'),
    lambda x: _swap(x, b',"term":0', b',"term":4294967296'),
    lambda x: _swap(x, b',"t_epoch_ns":', b',"t":'),
    lambda x: _swap(x, b',"t_epoch_ns":', b',"t_epoch_ns":-'),
    lambda x: _swap(x, b',"k":', b',"K":'),
    lambda x: _swap(x, b',"k":"', b',"k":"\x01'),
    lambda x: _swap(x, b',"cell":', b',"Cell":'),
    lambda x: _swap(x, b',"cell":', b',"cell":99999999999999999999'),
    lambda x: _swap(x, b',"cls":', b',"Cls":'),
    lambda x: _swap(x, b',"cls":', b',"cls":4294967296'),
    lambda x: _swap(x, b',"by":', b',"By":'),
    lambda x: _swap(x, b',"by":"', b',"by":"\\q'),
    lambda x: _swap(x, b',"body":', b',"Body":'),
    lambda x: x[: x.find(b',"body":') + 8] + x[x.rfind(b',"prev":"') :],
    lambda x: _swap(x, b',"prev":"', b'x,"prev":"', True),
    lambda x: _swap(x, b',"body":{"', b',"body":{"!'),
]


def damaged(lines: DataFrame, period: int) -> DataFrame:
    """Lines in which event number n suffers damage n modulo ``period``, if there is one of that number."""

    def run(batches):
        for batch in batches:
            hurt = [x if e is None or e % period >= len(DAMAGES) else DAMAGES[e % period](x) for e, x in zip(batch.column("event").to_pylist(), batch.column("line").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("line"), "line", pa.array(hurt, pa.binary()))

    return lines.mapInArrow(run, LINES)


def generated_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and the generator's body of that number, in the JVM."""
    i = F.col("event_id")
    status = F.element_at(F.array(F.lit("open"), F.lit("picked"), F.lit("shipped")), (i % 3 + 1).cast("int"))
    body = F.concat(
        F.lit('{"facts":[{"table":"orders","key":"o-'), (i % 9973).cast("string"), F.lit('","op":"'), F.when(i % 5 == 0, "insert").otherwise("update"), F.lit('","source_pos":'), (i + 1_000_000).cast("string"),
        F.lit(',"after":{"status":"'), status, F.lit('","amount_cents":'), (i * 977 % 1_000_000).cast("string"), F.lit('}}],"basis_pos":'), i.cast("string"), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))
