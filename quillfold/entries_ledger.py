"""Registered queries over ledgers that are made of the supplied events, and over what they are written with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.functions.convert import cents
from quillfold.functions.expr import CompileError, compile_text
from quillfold.functions.hashing import blake2b, cell_id_column, row_digest
from quillfold.functions.jsonlines import base64_strict_column, invalid_at
from quillfold.functions.wire import REQUEST, RESPONSE, decoded, encoded
from quillfold.operators import admit, enrich, state, verify
from quillfold.operators.rules import ClassDef, ClassMap, RevRule
from quillfold.operators.transactor import attempt_digest_column
from quillfold.plans import snapshot
from quillfold.plans.ledgers import EVENTS_SQL, LINES, SEGMENT, STRETCH, damaged, event_lines, generated_bodies
from quillfold.plans.tables import FACTS_SQL, facts, table
from quillfold.registry import query
from quillfold.schema import GENESIS, REFUSE_BODY, SCAN_REASONS
from quillfold.sources.tape import dump, scan_lines
from quillfold.sources.writer import build_row

_SQL = f"WITH {FACTS_SQL}, {EVENTS_SQL}"
KEYS = ["ledger"]


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_lines(event_lines(spark, sf_dir), KEYS)


# -- scans


@query(f"""
{_SQL}
SELECT ledger, place AS pos, k, cell, cls, author AS "by", 1757000000000000000 + place * 1000000 AS t_epoch_ns, md5(body) AS body_md5, seg AS seg_first_pos, line_no FROM w
UNION ALL
SELECT ledger, seg, 'seg', 0, 0, 'system', 1757000000000000000 + seg * 1000000, md5('{{"first_pos":' || seg), seg, 1 FROM h""")
def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every ledger as it was written: scanned strictly, its hash computed again. A first row's body is compared up to the hash in it."""
    body = F.when(F.col("k") == "seg", F.regexp_extract("body", r'^\{"first_pos":[0-9]+', 0)).otherwise(F.col("body"))
    return tape(spark, sf_dir).where("scan_reason is null").select("ledger", "pos", "k", F.col("cell").cast("long").alias("cell"), "cls", "by", "t_epoch_ns", F.md5(body.cast("binary")).alias("body_md5"), "seg_first_pos", "line_no")


_REASONS = list(SCAN_REASONS)


@query(f"""
{_SQL}
SELECT ledger, seg AS seg_first_pos, line_no, CASE WHEN event % 32 < {len(_REASONS)} THEN {_REASONS}[event % 32 + 1] END AS scan_reason FROM w
UNION ALL
SELECT ledger, seg, 1, NULL FROM h""")
def ledger_damages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows in four suffer one of the damages that a scan tells apart: each gets its own reason, the others none."""
    return scan_lines(damaged(event_lines(spark, sf_dir), 32), KEYS).select("ledger", "seg_first_pos", "line_no", "scan_reason")


@query(f"{_SQL} SELECT CASE WHEN event % 32 < {len(_REASONS)} THEN {_REASONS}[event % 32 + 1] ELSE 'readable' END AS reason, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT 'first rows', count(*) FROM h")
def ledger_scan_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_lines(damaged(event_lines(spark, sf_dir), 32), KEYS)
    kind = F.when(F.col("k") == "seg", "first rows").otherwise(F.coalesce("scan_reason", F.lit("readable")))
    return rows.groupBy(kind.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SQL} SELECT ledger, place AS pos, cell, body FROM w WHERE k = 'tx' AND place BETWEEN 250 AND 1250")
def ledger_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writes of a range of positions of each ledger."""
    return dump(tape(spark, sf_dir), 250, 1250, "tx").select("ledger", "pos", F.col("cell").cast("long").alias("cell"), "body")


@query(f"{_SQL} SELECT ledger, k, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT ledger, 'seg', count(*) FROM h GROUP BY ALL")
def ledger_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.kinds(tape(spark, sf_dir), KEYS)


# -- verification

_SKIPPED, _BENT, _LATE = (f"event % 400 = {n}" for n in (7, 100, 250))


@query(f"""
{_SQL},
x AS (SELECT *, lag(event) OVER (PARTITION BY ledger ORDER BY event) AS before FROM w),
p AS (
  SELECT ledger, seg, line_no, unnest(['prev_link', 'position']) AS problem FROM x WHERE before % 400 IN (7, 100)
  UNION ALL SELECT ledger, seg, line_no, 'hash_mismatch' FROM x WHERE {_BENT}
  UNION ALL SELECT ledger, seg, line_no, 'epoch' FROM x WHERE {_LATE}
  UNION ALL SELECT ledger, seg, line_no, unnest(['prev_link', 'position', 'first_row_not_seg']) FROM x WHERE i % {SEGMENT} = 0 AND i // {SEGMENT} % 3 = 1)
SELECT ledger, seg AS seg_first_pos, line_no, problem FROM p""")
def ledger_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers with rows left out, bent and stamped late, and segments without their first row: what a verification finds, and where."""
    lines = event_lines(spark, sf_dir, lambda event: event % 400 == 250)
    lines = lines.where(f"event is null or not {_SKIPPED}").where(f"event is not null or div(seg_first_pos, {SEGMENT + 1}) % 3 <> 1")
    bent = F.when(F.expr(_BENT), F.encode(F.replace(F.decode("line", "UTF-8"), F.lit(',"term":0'), F.lit(',"term":7')), "UTF-8")).otherwise(F.col("line"))
    return verify.breaks(scan_lines(lines.withColumn("line", bent), KEYS), KEYS)


@query(f"{_SQL} SELECT ledger, count(*) AS segments, CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS breaks FROM (SELECT ledger, seg, count(*) + 1 AS n FROM w GROUP BY ALL) GROUP BY ALL")
def ledger_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ledgers have no break."""
    rows = tape(spark, sf_dir)
    found = verify.breaks(rows, KEYS).groupBy("ledger").agg(F.count(F.lit(1)).alias("breaks"))
    sizes = rows.groupBy("ledger").agg(F.count_distinct("seg_first_pos").alias("segments"), F.count(F.lit(1)).alias("rows"))
    return sizes.join(found, "ledger", "left").select("ledger", "segments", "rows", F.coalesce("breaks", F.lit(0)).cast("long").alias("breaks"))


@query(f"""
{_SQL}, s AS (SELECT ledger, max(seg) AS seg, max(place) AS place FROM w GROUP BY ALL)
SELECT ledger, CASE WHEN ledger % 3 = 0 THEN 2 ELSE 0 END AS ghost_segments, CASE WHEN ledger % 3 = 0 THEN 7 ELSE 0 END AS ghost_bytes, CASE WHEN ledger % 2 = 0 THEN 10 + ledger ELSE 0 END AS torn_tail_bytes, place AS last_pos FROM s""")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers whose writer was stopped: torn tails, and trailing segments without a whole row."""
    lines = event_lines(spark, sf_dir)
    last = lines.groupBy("ledger").agg(F.max("seg_first_pos").alias("seg_first_pos"))
    nothing = F.lit(None).cast("long")
    row = lambda seg, number, n: [F.col("ledger"), nothing.alias("event"), seg.alias("seg_first_pos"), F.lit(number).cast("long").alias("line_no"), F.repeat(F.lit("t"), n).cast("binary").alias("line"), F.lit(False).alias("whole")]
    torn = last.where("ledger % 2 = 0").select(row(F.col("seg_first_pos"), 99_999, (F.col("ledger") + 10).cast("int")))
    ghosts = [last.where("ledger % 3 = 0").select(row(F.col("seg_first_pos") + k * 5000, 1, F.lit(n))) for k, n in ((1, 3), (2, 4))]
    for more in (torn, *ghosts):
        lines = lines.unionByName(more)
    out = verify.statuses(scan_lines(lines, KEYS), KEYS)
    return out.select("ledger", F.col("ghost_segments").cast("int"), F.col("ghost_bytes").cast("int"), "torn_tail_bytes", "last_pos")


@query(f"{_SQL}, s AS (SELECT ledger, max(place) AS place FROM w GROUP BY ALL) SELECT ledger, place AS last_pos, true AS head_is_expected FROM s")
def ledger_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each ledger; a row built after it with its hash is its successor."""
    last = F.max_by(F.struct("pos", "h", "t_epoch_ns"), "pos")
    heads = tape(spark, sf_dir).where("scan_reason is null").groupBy("ledger").agg(last.alias("e")).select("ledger", "e.*")

    def followed(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [build_row(p + 1, t + 1, "tick", 0, 0, "system", b'{"x":1}', h)[0][:-1] for p, h, t in zip(*(batch.column(c).to_pylist() for c in ("pos", "h", "t_epoch_ns")), strict=True)]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([batch.column("ledger"), pa.array([None] * n, pa.int64()), batch.column("pos"), pa.array([1] * n, pa.int64()), pa.array(rows, pa.binary()), pa.array([True] * n)], names=[c.split()[0] for c in LINES.split(", ")])

    after = scan_lines(heads.mapInArrow(followed, LINES), KEYS).select("ledger", "prev", (F.col("pos") - 1).alias("pos"))
    return heads.join(after, ["ledger", "pos"]).select("ledger", F.col("pos").alias("last_pos"), ((F.col("prev") == F.col("h")) & (F.col("h") != GENESIS)).alias("head_is_expected"))


# -- replay

_REPLAYED = f"""
{_SQL}, r AS (SELECT *, CASE WHEN lag(source_pos) OVER (PARTITION BY ledger, tbl, cell ORDER BY place) = source_pos THEN 'dup' ELSE 'applied' END AS rv FROM w WHERE k = 'tx'<bound>)"""
_CELLS = """
SELECT ledger, tbl AS "table", cell::VARCHAR AS key, arg_max(amount_minor, CASE WHEN rv = 'applied' THEN place END) AS amount_minor, arg_max(state, CASE WHEN rv = 'applied' THEN place END) AS state,
  max(place) AS pos_last, count(*) FILTER (rv = 'applied') AS n_applied, 1757000000000000000 + min(place) * 1000000 AS opened_ns FROM r GROUP BY ALL"""


def _named(cells: DataFrame, written: DataFrame) -> DataFrame:
    """Cells with the key that their id is made of."""
    names = written.groupBy("cell").agg(F.min(F.struct("source", "table", "key")).alias("_of"))
    ledger = F.substring("_of.source", 8, 20).cast("long")
    return cells.join(names, "cell").select(ledger.alias("ledger"), "_of.table", "_of.key", "amount_minor", F.col("state").cast("long").alias("state"), "pos_last", "n_applied", "opened_ns")


@query(_REPLAYED.replace("<bound>", "") + _CELLS)
def ledger_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by replay of the writes that stand on the ledgers."""
    written = state.facts_of(tape(spark, sf_dir))
    return _named(state.cells_of(state.replayed(written)), written)


@query(_REPLAYED.replace("<bound>", " AND place <= 2500") + _CELLS)
def ledger_cells_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as of a position of each ledger: a filter below the fold."""
    written = state.facts_of(state.as_of(tape(spark, sf_dir), 2500))
    return _named(state.cells_of(state.replayed(written)), written)


@query(_REPLAYED.replace("<bound>", "") + _CELLS)
def ledger_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot as of a position and the fold of what follows: the state of the whole."""
    written = state.facts_of(tape(spark, sf_dir))
    old = state.cells_of(state.replayed(state.as_of(written, 2500)))
    return _named(snapshot.continued(old, written.where("pos > 2500")), written)


@query(_REPLAYED.replace("<bound>", "") + _CELLS)
def ledger_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are delivered again, in any order, change nothing."""
    rows = tape(spark, sf_dir)
    twice = state.facts_of(rows.unionByName(rows.where("pos % 3 = 0")))
    written = twice.dropDuplicates(["cell", "pos", "idx"])
    return _named(state.cells_of(state.replayed(written)), written)


_TICKED = f"""{_REPLAYED.replace('<bound>', '')}, m AS (SELECT *, coalesce(lag(amount_minor) OVER (PARTITION BY ledger, tbl, cell ORDER BY place), 0) AS was FROM r WHERE rv = 'applied'),
t AS (SELECT ledger, max(place) AS tick FROM w WHERE k = 'tick' AND pos % 2 = 0 GROUP BY ALL)"""


@query(f"{_TICKED} SELECT m.ledger, cls, CAST(sum(greatest(amount_minor - was, 0)) AS BIGINT) AS cap_used FROM m LEFT JOIN t ON m.ledger = t.ledger WHERE place > coalesce(tick, -1) GROUP BY ALL")
def ledger_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure by class of each ledger since its last cap period tick."""
    rows = tape(spark, sf_dir)
    ledger = F.substring("source", 8, 20).cast("long")
    added = state.increases(state.replayed(state.facts_of(rows))).withColumn("ledger", ledger)
    ticks = state.cap_ticks(rows, KEYS).groupBy("ledger").agg(F.max("pos").alias("tick"))
    return added.join(ticks, "ledger", "left").where("pos > coalesce(tick, -1)").groupBy("ledger", "cls").agg(F.sum("increase").alias("cap_used"))


@query(f"""{_SQL} SELECT ledger, json_extract_string(body, '$.reason') AS reason, count(*) AS entries, CAST(sum(CAST(json_extract_string(body, '$.count') AS BIGINT)) AS BIGINT) AS refusals FROM w WHERE k = 'refuse' GROUP BY ALL""")
def ledger_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals by reason, each entry for as many as it counts."""
    told = tape(spark, sf_dir).where("k = 'refuse'").select("ledger", F.from_json("body", REFUSE_BODY).alias("r"))
    return told.groupBy("ledger", F.col("r.reason").alias("reason")).agg(F.count(F.lit(1)).alias("entries"), F.sum("r.count").alias("refusals"))


@query(f"{_SQL} SELECT ledger, place AS pos FROM w WHERE k = 'tx' AND event % 50 IN (3, 4)")
def ledger_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes whose body departs from the writer's order or ends early give no facts and are told."""
    rows = tape(spark, sf_dir).where("k = 'tx'")
    event = F.col("ledger") * STRETCH + F.col("pos") - F.call_function("div", F.col("pos"), F.lit(SEGMENT + 1)).cast("long")
    swapped = F.regexp_replace("body", r'^\{("client_id":"[^"]*"),("request_id":"[^"]*"),', r"{$2,$1,")
    body = F.when(event % 50 == 3, swapped).when(event % 50 == 4, F.regexp_replace("body", r"\]\}$", "]")).otherwise(F.col("body"))
    return state.unreadable(rows.withColumn("body", body)).select("ledger", "pos")


@query(f"{_SQL} SELECT ledger, place AS pos, CAST(json_extract_string(body, '$.deadline_wheel_pos') AS BIGINT) AS wheel FROM w WHERE k = 'tick' AND pos % 2 = 0")
def ledger_cap_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir)
    wheel = F.from_json("body", "cadence_rule string, deadline_wheel_pos long")["deadline_wheel_pos"]
    return rows.join(state.cap_ticks(rows, KEYS), ["ledger", "pos"], "left_semi").select("ledger", "pos", wheel.alias("wheel"))


@query(f"""{_SQL} SELECT ledger, place AS pos, event, row_number() OVER (PARTITION BY ledger, cell ORDER BY place) AS nth, place - lag(place) OVER (PARTITION BY ledger, cell ORDER BY place) AS gap FROM w WHERE k <> 'refuse'
  AND ledger IN (SELECT ledger FROM w GROUP BY 1 HAVING count(*) > 10) AND cell IN (SELECT cell FROM w WHERE k = 'refuse')""")
def ledger_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the ledgers with nested queries and windows: rows of cells that were ever refused."""
    lines = event_lines(spark, sf_dir)
    rows = scan_lines(lines, KEYS).where("k <> 'seg'").join(lines.where("event is not null").select("ledger", "seg_first_pos", "line_no", "event"), ["ledger", "seg_first_pos", "line_no"])
    return spark.sql(
        """SELECT ledger, pos, event, CAST(row_number() OVER (PARTITION BY ledger, cell ORDER BY pos) AS BIGINT) AS nth, pos - lag(pos) OVER (PARTITION BY ledger, cell ORDER BY pos) AS gap FROM {tape} WHERE k <> 'refuse'
        AND ledger IN (SELECT ledger FROM {tape} GROUP BY ledger HAVING count(*) > 10) AND cell IN (SELECT cell FROM {tape} WHERE k = 'refuse')""",
        tape=rows.select("ledger", "pos", "event", "k", "cell"),
    )


# -- identities and codecs


@query(f"WITH {FACTS_SQL} SELECT cell, tbl AS \"table\", count(*) AS n, true AS one_id, true AS own_id FROM f GROUP BY ALL")
def cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key has one id, and no two keys share one."""
    f = facts(spark, sf_dir).withColumn("id", cell_id_column(F.lit("events"), F.col("table"), F.col("cell").cast("string")))
    by_key = f.groupBy("cell", "table").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max("id").alias("top"))
    owners = by_key.groupBy("id").agg(F.count(F.lit(1)).alias("keys"))
    return by_key.join(owners, "id").select("cell", "table", "n", (F.col("id") == F.col("top")).alias("one_id"), (F.col("keys") == 1).alias("own_id"))


@query("SELECT true AS order_is_nothing, true AS a_row_counts, true AS a_value_counts, count(*) AS n FROM orders")
def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a table doesn't follow the order of its rows, but every row and value."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    columns = o.columns
    whole, n = row_digest(o, columns)
    top = o.agg(F.max("o_orderkey")).first()[0]
    other = row_digest(o.repartition(7, "o_totalprice"), columns)[0]
    fewer = row_digest(o.where(F.col("o_orderkey") != F.lit(top)), columns)[0]
    changed = row_digest(o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == F.lit(top), "x").otherwise(F.col("o_orderstatus"))), columns)[0]
    return spark.createDataFrame([(whole == other, whole != fewer, whole != changed, n)], "order_is_nothing boolean, a_row_counts boolean, a_value_counts boolean, n long")


@query("""SELECT event_id, md5('{"facts":[{"table":"orders","key":"o-' || (event_id % 9973) || '","op":"' || CASE WHEN event_id % 5 = 0 THEN 'insert' ELSE 'update' END || '","source_pos":' || (1000000 + event_id)
  || ',"after":{"status":"' || CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'picked' ELSE 'shipped' END || '","amount_cents":' || (event_id * 977 % 1000000) || '}}],"basis_pos":' || event_id || '}') AS body_md5 FROM events""")
def generator_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic generator's bodies by number."""
    return generated_bodies(spark, sf_dir).select("event_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


_BAD = (b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5\x80\x80\x80", b"\xe2\x9c", b"\x80")


@query(f"SELECT doc_id, CASE WHEN doc_id % {len(_BAD) + 1} < {len(_BAD)} THEN octet_length(encode(text)) END AS invalid_at FROM documents")
def utf8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with bytes behind them that aren't UTF-8: the offset of the first wrong one; every sixth is left as it is."""
    d = table(spark, sf_dir, "documents")
    tails = F.element_at(F.array(*[F.lit(b) for b in _BAD], F.lit(b"")), (F.col("doc_id") % (len(_BAD) + 1) + 1).cast("int"))
    return d.select("doc_id", invalid_at(F.concat(F.col("text").cast("binary"), tails)).alias("invalid_at"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN md5(text) END AS decoded_md5 FROM documents""")
def base64_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts coded and decoded: one in four as it is, the others with a line break, without the padding's last byte, or with a byte that has no place there."""
    coded = F.regexp_replace(F.base64(F.concat(F.col("text").cast("binary"), F.unhex(F.lit("0A")))), r"\r\n", "")
    plain = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\r\n", "")
    kind = F.col("doc_id") % 4
    hurt = F.when(kind == 0, plain).when(kind == 1, F.concat(coded, F.lit("\n"))).when(kind == 2, F.expr("substring(b64, 1, length(b64) - 1)")).otherwise(F.concat(F.lit("*"), coded))
    rows = table(spark, sf_dir, "documents").withColumn("b64", coded).withColumn("hurt", hurt)
    return rows.select("doc_id", F.md5(base64_strict_column(F.col("hurt").cast("binary"))).alias("decoded_md5"))


@query("SELECT doc_id, md5(hex(encode(text))) AS upper_md5, md5(lower(hex(encode(text)))) AS lower_md5, true AS back FROM documents")
def hex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal text out in either case, and back."""
    raw = F.col("text").cast("binary")
    up, low = F.hex(raw), F.lower(F.hex(raw))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(up.cast("binary")).alias("upper_md5"), F.md5(low.cast("binary")).alias("lower_md5"), ((F.unhex(up) == raw) & (F.unhex(low) == raw)).alias("back"))


@query("SELECT doc_id, true AS keyed_by_text, 64 AS width FROM documents")
def blake2b_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole texts: as many as there are texts, and equal for equal ones only."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", blake2b("text").alias("h"), F.sha2("text", 256).alias("s"))
    one = rows.groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    other = rows.groupBy(F.col("s")).agg(F.min("h").alias("c"), F.max("h").alias("d"))
    found = rows.join(one, "h").join(other, "s")
    return found.select("doc_id", ((F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))).alias("keyed_by_text"), F.length("h").alias("width"))


# -- requests and responses

_CALL = "CASE event_id % 4 WHEN 0 THEN 'write' WHEN 1 THEN 'tick' WHEN 2 THEN 'health' ELSE 'head' END"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce("props", F.lit("")).alias("body"), F.expr(_CALL).alias("call"), F.concat(F.lit('seat "'), F.col("user_id").cast("string"), F.lit('"\\\n')).alias("by"), F.col("event_type").alias("arg"))
    return e.withColumn("body", F.when(F.col("event_id") % 4 == 0, F.col("body")).otherwise(F.lit("")))


@query(f"""
SELECT event_id, CASE WHEN event_id % 7 < 4 THEN {_CALL} END AS call, CASE WHEN event_id % 7 < 4 THEN 'seat "' || user_id || '"' || chr(92) || chr(10) END AS by, CASE WHEN event_id % 7 < 4 THEN event_type END AS arg,
  CASE WHEN event_id % 7 < 4 THEN CASE WHEN event_id % 4 = 0 THEN coalesce(props, '') ELSE '' END END AS body FROM events""")
def wire_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request lines, written and read again; three in seven are hurt and refused whole."""
    rows = _requests(spark, sf_dir)
    line = encoded(REQUEST, {n: F.col(n) for n, _ in REQUEST})
    kind = F.col("event_id") % 7
    hurt = F.when(kind == 4, F.concat(line, F.lit(" "))).when(kind == 5, F.replace(line, F.lit(',"by":'), F.lit(',"By":'))).when(kind == 6, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return rows.select("event_id", decoded(REQUEST, hurt).alias("r")).select("event_id", "r.*")


@query("""SELECT event_id, event_id % 2 = 0 AS ok, CASE WHEN event_id % 5 < 4 THEN event_id * 1000003 END AS pos, CASE WHEN event_id % 5 < 4 THEN md5(event_type) END AS h, CASE WHEN event_id % 5 < 4 THEN event_type END AS fault FROM events WHERE event_id % 5 < 4
  UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM events WHERE event_id % 5 = 4""")
def wire_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response lines; those whose position has a leading zero are refused."""
    e = table(spark, sf_dir, "events")
    blank = F.lit("")
    line = encoded(RESPONSE, {"ok": F.col("event_id") % 2 == 0, "pos": F.col("event_id") * 1000003, "h": F.md5(F.col("event_type").cast("binary")), "refusal": blank, "constraint_id": blank, "fault": F.col("event_type"), "info": blank})
    hurt = F.when(F.col("event_id") % 5 == 4, F.replace(line, F.lit('"pos":'), F.lit('"pos":0'))).otherwise(line)
    return e.select("event_id", decoded(RESPONSE, hurt).alias("r")).select("event_id", "r.ok", F.col("r.pos").cast("long").alias("pos"), "r.h", "r.fault")


_ASKED = """SELECT event_id AS seq, CASE WHEN event_id % 41 = 0 THEN '' ELSE 'c' || (user_id % 9) END AS client_id, 'r' || (event_id // 30) AS request_id, event_id % 1100 AS n_facts, event_id + event_id % 7 - 5 AS basis_pos, event_id - 1 AS committed FROM events"""


@query(f"""
WITH q AS ({_ASKED}), a AS (SELECT *, n_facts > 1000 AS large, client_id = '' AS nameless, basis_pos > committed AS stale FROM q),
b AS (SELECT *, coalesce(sum(CASE WHEN large OR nameless OR stale THEN 0 ELSE 1 END) OVER (PARTITION BY client_id, request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM a)
SELECT seq, CASE WHEN large THEN 'too_large' WHEN nameless THEN 'malformed' WHEN done > 0 THEN 'duplicate_request' WHEN stale THEN 'stale_basis' END AS fault FROM b""")
def request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a request before its facts are judged, in the order of the rules."""
    asked = spark.sql(_ASKED.replace("event_id // 30", "event_id div 30").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return admit.request_faults(asked).select("seq", "fault")


@query(f"WITH {FACTS_SQL} SELECT pos, true AS told_apart FROM f")
def attempt_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts have one digest exactly if they are the same attempt: who, which request and which facts, but not the amounts."""
    f = facts(spark, sf_dir)
    who = [F.concat(F.lit("c"), (F.col("cell") % 5).cast("string")), F.concat(F.lit("r"), (F.col("pos") % 50).cast("string")), F.lit("seat:a"), F.lit("events"), F.col("table"), F.col("cell").cast("string"), F.col("op"), (F.col("source_pos") % 3).cast("string")]
    rows = f.select("pos", attempt_digest_column(*who).alias("digest"), F.to_json(F.array(*who)).alias("attempt"))
    one = rows.groupBy("digest").agg(F.min("attempt").alias("a"), F.max("attempt").alias("b"))
    other = rows.groupBy("attempt").agg(F.min("digest").alias("c"), F.max("digest").alias("d"))
    return rows.join(one, "digest").join(other, "attempt").select("pos", ((F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))).alias("told_apart"))


# -- declarations

_TEXTS = {
    "state": "expr_not_bool", "nope == 1": "expr_unknown_column", "state == 1 == 2": "expr_parse", "state && true": "expr_type", "01 == 1": "expr_parse", "9223372036854775808 > 0": "expr_overflow",
    "(" * 65 + "true" + ")" * 65: "expr_too_complex", "true == true": "expr_type", "1.5 > 1": "expr_parse", "!!true": None, "--1 == 1": None, "(" * 64 + "true" + ")" * 64: None, "!1 == 1": "expr_type", "min(1) == 1": "expr_parse", "": "expr_parse",
}


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("SELECT n, reason FROM (VALUES " + ", ".join(f"({i}, {_literal(r)}::VARCHAR)" for i, r in enumerate(_TEXTS.values())) + ") AS t(n, reason)")
def constraint_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint texts that don't compile, with their reasons, and some that do."""

    def told(text: str) -> str | None:
        try:
            compile_text(text)
        except CompileError as e:
            return e.reason
        return None

    return spark.createDataFrame([(i, told(t)) for i, t in enumerate(_TEXTS)], "n int, reason string")


_DECLARED = {
    "whole": (("lineitem.l_extendedprice", "sum"), None), "table": (("nowhere.x", "sum"), "enrich_unknown_table"), "column": (("lineitem.nope", "sum"), "enrich_unknown_source_column"), "path": (("part.p_size", "sum"), "enrich_no_join_path"),
    "unqualified": (("l_extendedprice", "sum"), "enrich_unqualified_column"), "reducer": (("lineitem.l_extendedprice", ""), "enrich_no_reducer"), "own": (("orders.o_totalprice", ""), None),
}


@query("SELECT name, reason FROM (VALUES " + ", ".join(f"('{k}', {_literal(r)}::VARCHAR)" for k, (_, r) in _DECLARED.items()) + ") AS t(name, reason)")
def enrich_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of an enrichment that are refused, with their reasons."""
    frames = {n: table(spark, sf_dir, n).columns for n in ("orders", "lineitem", "part")}
    out = []
    for name, ((source, reducer), _) in _DECLARED.items():
        ingest = enrich.IngestDef("orders", "o_orderkey", (enrich.EnrichedColumn("x", source, reducer) if reducer else enrich.EnrichedColumn("x", source),), (enrich.SideJoin("lineitem", "l_orderkey", "orders", "o_orderkey"),))
        try:
            ingest.validate(frames)
            out.append((name, None))
        except enrich.DeclarationRefused as e:
            out.append((name, e.reason))
    return spark.createDataFrame(out, "name string, reason string")


_PROGRAMS = {"state == 1": ("state", 0), "state  ==1": ("state", 0), "(state) == 1": ("state", 0), "state == 2": ("state", 3), "due_ns > 0 && amount_minor < 5": ("amount_minor,due_ns", 4), "amount_minor < 5 && due_ns > 0": ("amount_minor,due_ns", 5), "true": ("", 6)}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{reads}', {same})" for i, (reads, same) in enumerate(_PROGRAMS.values())) + ") AS t(n, reads, same_as)")
def constraint_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What programs read, and the first that each has its hash from: spelling is nothing, order is."""
    programs = [compile_text(t) for t in _PROGRAMS]
    hashes = [p.program_hash for p in programs]
    return spark.createDataFrame([(i, ",".join(sorted(p.reads)), hashes.index(p.program_hash)) for i, p in enumerate(programs)], "n int, reads string, same_as int")


_PIN_BASE = dict(rules=(RevRule("*", "*", "irreversible"), RevRule("a", "insert", "reversible_by_inverse")), cap_minor_per_period=5, quorum_n=1, quorum_m=2)
_PINNED = {
    "same": ({}, {}, False), "spelling": ({}, {"c": "state  == 1"}, False), "meaning": ({}, {"c": "state == 2"}, True), "cap": ({"cap_minor_per_period": 6}, {}, True), "quorum": ({"quorum_n": 2}, {}, True),
    "order": ({"rules": _PIN_BASE["rules"][::-1]}, {}, True), "window": ({"rules": (RevRule("*", "*", "irreversible", 9), _PIN_BASE["rules"][1])}, {}, True), "flags": ({"flags": 1}, {}, True),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(m).lower()})" for k, (_, _, m) in _PINNED.items()) + ") AS t(change, moved)")
def declaration_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changes of a class move its pin, and so that of the map."""
    made = lambda more, checks: ClassMap().add(ClassDef.of(1, "x", {"c": "state == 1"} | checks, **_PIN_BASE | more)).pin()
    return spark.createDataFrame([(k, made(more, checks) != made({}, {})) for k, (more, checks, _) in _PINNED.items()], "change string, moved boolean")


# -- set operations, late facts


@query(f"""
WITH {FACTS_SQL}, a AS (SELECT cell, cls FROM f WHERE pos % 2 = 0), b AS (SELECT cell, cls FROM f WHERE state = 4)
SELECT 'both' AS part, cell, cls FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', cell, cls FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second', cell, cls FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    a, b = f.where("pos % 2 = 0").select("cell", "cls"), f.where("state = 4").select("cell", "cls")
    part = lambda name, rows: rows.select(F.lit(name).alias("part"), "cell", "cls")
    return part("both", a.intersect(b)).unionByName(part("first", a.subtract(b))).unionByName(part("second", b.subtract(a)))


@query(f"WITH {FACTS_SQL} SELECT cell, pos, source_pos, top - source_pos AS behind FROM v WHERE verdict = 'stale_source'")
def late_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that come after a later state of their source, and by how much."""
    f = facts(spark, sf_dir)
    before = Window.partitionBy("cell").orderBy("pos", "idx").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.max("source_pos").over(before) - F.col("source_pos")
    return state.admitted(f.withColumn("behind", behind)).where("verdict = 'stale_source'").select("cell", "pos", "source_pos", "behind")


@query("""SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_minor FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
  AND o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY o_custkey""")
def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested queries, correlated and scalar."""
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    large = o.join(items.where("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    mean = o.agg(F.avg("o_totalprice").alias("mean"))
    return large.join(F.broadcast(mean), F.col("o_totalprice") > F.col("mean")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("o_totalprice"))).alias("total_minor"))

