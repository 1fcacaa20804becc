import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfold.operators import designed, field, grades, state
from quillfold.operators.blocks import next_above, running_last, running_max
from quillfold.operators.enrich import BackFill, DeclarationRefused, EnrichedColumn, IngestDef, SideJoin, compile_ingest
from quillfold.operators.ordered import coalesced_refusals, token_bucket
from quillfold.operators.rules import ClassDef, RevRule
from quillfold.operators.transactor import Config, Fact, Request, Transactor, attempt_digest, attempt_digest_column
from quillfold.operators.rules import ClassMap
from quillfold.functions.convert import epoch_ns, minor_units
from quillfold.plans import snapshot
from quillfold.plans.views import Ledger
from quillfold.sources.csv_files import read_csv, write_csv
from quillfold.streaming.sink import transacted
from quillfold.sources.writer import LedgerWriter
from quillfold.streaming.tape_stream import CellsFold, follow

SCHEMA = {"orders": ["order_id", "status"], "items": ["order_id", "price"]}


def ingest(*reducers):
    return IngestDef("orders", "order_id", tuple(EnrichedColumn(r, "items.price", r) for r in reducers), (SideJoin("items", "order_id", "orders", "order_id"),))


def test_reducers(spark):
    orders = spark.createDataFrame([(1, "a"), (2, "b")], "order_id long, status string")
    items = spark.createDataFrame([(1, i, p) for i, p in enumerate([300, 100, 200, 100])] + [(9, 0, 5)], "order_id long, seq long, price long")
    row = compile_ingest(ingest("sum", "min", "max", "first", "last", "count", "distinct_count"), {"orders": orders, "items": items}, order={"items": ["seq"]}).frame.orderBy("order_id").collect()
    assert tuple(row[0])[1:] == (4, 700, 100, 300, 300, 100, 4, 3, None)
    assert tuple(row[1])[1:] == (0,) * 8 + (None,)


def test_sum_overflow_is_named(spark):
    orders = spark.createDataFrame([(1, "a")], "order_id long, status string")
    items = spark.createDataFrame([(1, 2**63 - 1), (1, 1)], "order_id long, price long")
    row = compile_ingest(ingest("sum"), {"orders": orders, "items": items}).frame.first()
    assert row["sum"] is None and row["refused"] == "overflow:sum"


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"class_table": "none"}, "enrich_unknown_table"), ({"key_col": "none"}, "enrich_unknown_source_column"), ({"joins": ()}, "enrich_no_join_path"),
        ({"columns": (EnrichedColumn("x", "price", "sum"),)}, "enrich_unqualified_column"), ({"columns": (EnrichedColumn("x", "items.price"),)}, "enrich_no_reducer"),
        ({"back_fill": (BackFill("items", ("nope",)),)}, "enrich_unresolved_column"), ({"joins": (SideJoin("items", "order_id", "items", "order_id"),)}, "enrich_no_join_path"),
    ],
)
def test_declarations_are_refused(change, reason):
    fields = {k: getattr(ingest("sum"), k) for k in ("class_table", "key_col", "columns", "joins", "back_fill")} | change
    with pytest.raises(DeclarationRefused) as e:
        IngestDef(**fields).validate(SCHEMA)
    assert e.value.reason == reason
    assert IngestDef(**fields).pin() != ingest("sum").pin()


def test_reversibility_precedence():
    c = ClassDef.of(1, "x", rules=(RevRule("*", "*", "reversible_within"), RevRule("t", "*", "irreversible"), RevRule("t", "*", "reversible_within"), RevRule("*", "del", "reversible_by_inverse")))
    assert [c.reversibility_of(*x) for x in (("t", "del"), ("u", "del"), ("u", "ins"))] == ["irreversible", "reversible_by_inverse", "reversible_within"]
    assert ClassDef.of(1, "x").reversibility_of("t", "del") == "irreversible"


def test_every_field_moves_the_pin():
    base = dict(cls=1, name="n", checks={"c": "state == 1"}, rules=(RevRule("t", "o", "irreversible", 5),), cap_minor_per_period=7, quorum_m=1, quorum_n=2, flags=3)
    pins = {ClassDef.of(**base).pin()}
    for change in (dict(cls=2), dict(name="m"), dict(checks={"d": "state == 1"}), dict(checks={"c": "state == 2"}), dict(rules=()), dict(rules=(RevRule("t", "p", "irreversible", 5),)), dict(rules=(RevRule("t", "o", "irreversible", 6),)), dict(cap_minor_per_period=8), dict(quorum_m=2), dict(quorum_n=3), dict(flags=4)):
        pins.add(ClassDef.of(**base | change).pin())
    assert len(pins) == 12


def fact(key, amount=100, source_pos=1, cls=1, **more):
    return Fact("s", "orders", key, "update", source_pos, cls, amount, has_inverse=True, **more)


def transactor(folder, config=None, **more):
    clock = iter(range(10**18, 10**19, 1_000_000))
    classes = ClassMap().add(ClassDef.of(1, "orders", rules=(RevRule("*", "*", "reversible_by_inverse"),), **more))
    return Transactor(LedgerWriter(str(folder), now=lambda: next(clock), sync=False), classes, config or Config())


def test_write_path(tmp_path):
    t = transactor(tmp_path, cap_minor_per_period=1000)
    write = lambda i, *f, **m: t.write(Request("c", str(i), list(f), **m))
    first = write(1, fact("a", 600))
    again = write(1, fact("a", 900))
    assert first.committed and (again.pos, again.fault) == (first.pos, "duplicate_request")
    assert write(2, fact("b", 900)).constraint_id == "cap:orders"
    assert write(3, fact("b", 400)).committed and t.cap_used[1] == 1000
    assert write(4, fact("z", cls=42)).refusal == "unknown_class"
    assert write(5, fact("a", source_pos=0)).refusal == "stale_source"
    assert write(6, fact("a", 1, 1)).committed and t.dup_noops == 1
    assert write(7, basis_pos=10**6).fault == "stale_basis"
    assert write(8, kind="verb", by="seat:x").refusal == "not_authored_by_seam"
    t.tick("cap_period")
    assert write(9, fact("d", 900)).committed
    assert write(10, Fact("s", "orders", "n", cls=1, source_pos=1)).refusal == "no_inverse"
    assert write(11, fact("n"), declared_reversibility="irreversible").refusal == "reversibility_mismatch"
    assert write(12, Fact("s", "orders", "n", cls=1, source_pos=1, exogenous=True, has_inverse=True)).refusal == "reversibility_mismatch"
    assert write(13, *[fact(str(i)) for i in range(1001)]).fault == "too_large"
    assert t.write(Request("", "x")).fault == "malformed"
    t.leader = False
    assert write(14).fault == "not_leader"


def test_buckets_and_refusal_entries(spark, tmp_path):
    t = transactor(tmp_path, Config(burst=3, per_second=0), checks={"small": "amount_minor <= 1000"})
    assert [t.write(Request("c", str(i), [fact("a", 1, i + 1)])).fault for i in range(5)] == ["", "", "", "rate_limited", "rate_limited"]
    u = transactor(tmp_path / "u", checks={"small": "amount_minor <= 1000", "odd": "1000 / state == 1 || amount_minor > 0"})
    for i in range(50):
        assert u.write(Request("c", str(i), [fact("a", 5000)])).constraint_id == "small"
    assert u.write(Request("c", "div", [fact("d", 0)])).constraint_id == "odd:expr_div_by_zero"
    u.close()
    ledger = Ledger(spark, str(tmp_path / "u"))
    told = ledger.frames()["refusals"].where("constraint_id = 'small'").agg(F.sum("count"), F.count("*")).first()
    assert told[0] == 50 and told[1] < 50
    assert ledger.health()["refusals"] == {"constraint_violated": 51}


def test_replay_incremental_and_redelivery_agree(spark, tmp_path):
    r = random.Random(2)
    t = transactor(tmp_path / "led")
    for i in range(60):
        t.write(Request("c", str(i), [fact(str(r.randrange(7)), r.randrange(1000), r.randrange(1, 40)) for _ in range(r.randrange(1, 3))]))
    ledger = Ledger(spark, str(tmp_path / "led"))
    want = {c["id"]: (c["amount_minor"], c["src_pos_last"], c["opened_ns"], c["pos_last"]) for c in t.cells.values()}
    got = {int(r["cell"]): (r["amount_minor"], int(r["src_pos_last"]), r["opened_ns"], r["pos_last"]) for r in ledger.frames()["cells"].collect()}
    assert got == want
    assert {r["cls"]: r["cap_used"] for r in ledger.frames()["caps"].collect()} == dict(t.cap_used)
    assert ledger.query("SELECT count(*) AS n FROM cells", as_of_pos=3).first()["n"] <= 6
    fold = CellsFold(spark, str(tmp_path / "fold"))
    stream = follow(spark, str(tmp_path / "led")).writeStream.foreachBatch(fold.apply).option("checkpointLocation", str(tmp_path / "cp")).start()
    stream.processAllAvailable()
    t.write(Request("c", "later", [fact("3", 77, 1000)]))
    stream.processAllAvailable()
    stream.stop()
    assert len(fold._versions()) >= 2
    fold.apply(ledger.tape(), 10_000)  # everything once more
    kept = {int(r["cell"]): (r["amount_minor"], r["pos_last"]) for r in fold.cells().collect()}
    assert kept == {c["id"]: (c["amount_minor"], c["pos_last"]) for c in t.cells.values()}


def test_caps_are_kept_batch_by_batch(spark, tmp_path):
    """After each batch as by replay up to there: ticks inside batches, batches without facts, redelivered rows."""
    r = random.Random(4)
    t = transactor(tmp_path / "led")
    for i in range(40):
        t.write(Request("c", str(i), [fact(str(r.randrange(5)), r.randrange(1000), r.randrange(1, 40), cls=1) for _ in range(r.randrange(1, 3))]))
        if i in (11, 12, 29):
            t.tick("cap_period")
        elif i % 10 == 5:
            t.tick("other")
    tape, end = Ledger(spark, str(tmp_path / "led")).tape(), t.writer.committed_pos
    ticks = [x.pos for x in state.cap_ticks(tape).orderBy("pos").collect()]
    assert len(ticks) == 3
    fold, seen = CellsFold(spark, str(tmp_path / "fold")), 0
    for batch_id, (low, high) in enumerate([(0, 0), (1, 8), (5, ticks[1] + 4), (0, ticks[1] + 4), (ticks[1] + 5, ticks[2]), (ticks[2] + 1, end - 2), (end - 3, end), (0, end)]):
        fold.apply(tape.where(f"pos between {low} and {high}"), batch_id)
        fold.apply(tape.where(f"pos between {low} and {high}"), batch_id)
        seen = max(seen, high)
        cells, caps = state.rebuild(tape, seen)
        assert {x.cls: x.cap_used for x in fold.caps().collect()} == {x.cls: x.cap_used for x in caps.collect()}
        assert sorted((x.cell, x.amount_minor, x.pos_last) for x in fold.cells().collect()) == sorted((x.cell, x.amount_minor, x.pos_last) for x in cells.collect())
    assert {x.cls: x.cap_used for x in fold.caps().collect()} == dict(t.cap_used) and sum(t.cap_used.values()) > 0


def test_versions_are_merged_and_go(spark, tmp_path, monkeypatch):
    """Versions hold their own batch's cells; merged now and then, the state is that of the whole, and old versions are gone."""
    monkeypatch.setattr(CellsFold, "MERGED", 2)
    r = random.Random(5)
    t = transactor(tmp_path / "led")
    for i in range(30):
        t.write(Request("c", str(i), [fact(str(r.randrange(9)), r.randrange(1000), r.randrange(1, 40))]))
    tape, fold, sizes = Ledger(spark, str(tmp_path / "led")).tape(), CellsFold(spark, str(tmp_path / "fold")), []
    for batch_id, low in enumerate(range(0, 36, 6)):
        fold.apply(tape.where(f"pos between {low} and {low + 5}"), batch_id)
        sizes.append(fold._read(batch_id, "facts").count())
        want = {(int(c.cell), c.amount_minor, c.pos_last) for c in state.rebuild(tape, low + 5)[0].collect()}
        assert {(int(c.cell), c.amount_minor, c.pos_last) for c in fold.cells().collect()} == want
    assert min(sizes[1:]) < max(sizes) and 0 not in fold._versions() and len(fold._versions()) <= 4


def test_snapshot_and_tail_give_the_whole(spark, tmp_path):
    r = random.Random(5)
    t = transactor(tmp_path / "led")
    for i in range(40):
        t.write(Request("c", str(i), [fact(str(r.randrange(5)), r.randrange(1000), r.randrange(1, 60))]))
    ledger = Ledger(spark, str(tmp_path / "led"))
    digest = snapshot.take(ledger, 9, str(tmp_path / "snap"))
    assert digest == ledger.digest(9)[0]
    cells = snapshot.resume(spark, str(tmp_path / "led"), str(tmp_path / "snap"))
    assert ledger.verify_fold(cells) and not ledger.verify_fold(cells.where("cell > 0").limit(1))
    spark.createDataFrame([(9, "0" * 64, 1)], "pos long, digest string, n long").write.mode("overwrite").parquet(str(tmp_path / "snap" / "mark"))
    with pytest.raises(snapshot.SnapshotBroken):
        snapshot.resume(spark, str(tmp_path / "led"), str(tmp_path / "snap"))


def test_csv_and_sink(spark, tmp_path):
    rows = [("a", 'quote " and, comma', "58.90"), ("b", "", ""), ("c", "x", "1.234"), ("d", "y", "-1.5")]
    write_csv(spark.createDataFrame(rows, "k string, t string, money string").coalesce(1), str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), ["k", "t", "money"], "seq")
    assert [tuple(x) for x in back.orderBy("seq").select("k", "t", "money").collect()] == rows
    assert [x[0] for x in back.orderBy("seq").select(minor_units(F.col("money"))).collect()] == [5890, 0, None, -150]
    assert spark.range(1).select(epoch_ns(F.lit("2017-10-02 10:56:33")), epoch_ns(F.lit("")), epoch_ns(F.lit("2017-10-02"))).first()[:] == (1506941793000000000, 0, None)
    t = transactor(tmp_path / "led")
    kind = "array<struct<source:string,table:string,key:string,op:string,source_pos:long,cls:int,amount_minor:long,has_inverse:boolean>>"
    batch = spark.createDataFrame([(i, "c", str(i % 3), "seat:a", "tx", 0, None, [("s", "orders", "k", "update", i + 1, 1, 10, True)]) for i in range(5)], f"seq long, client_id string, request_id string, by string, kind string, basis_pos long, declared_reversibility string, facts {kind}")
    transacted(t)(batch, 0)
    transacted(t)(batch, 0)
    assert len(t.replies) == 3 and t.faults["duplicate_request"] == 7 and len(t.cells) == 1


def sequential_sweep(load, warrants, dev, c):
    s, k, t = load.shape
    dev = dev.astype(object).copy()
    for n in range(1, c.max_iters + 1):
        top = 0
        for colour in (0, 1):
            for a in range(s):
                for i in range(k):
                    for j in range(t):
                        if (i + j) % 2 != colour or warrants[a, i, j]:
                            continue
                        near = [(x, y, w) for x, y, w in ((i - 1, j, c.k_cls), (i + 1, j, c.k_cls), (i, j - 1, c.k_slot), (i, j + 1, c.k_slot)) if 0 <= x < k and 0 <= y < t]
                        d = int(dev[a, i, j])
                        rest = int(load[a, i, j]) * c.den + sum(w * (int(dev[a, x, y]) - d) for x, y, w in near) - c.decay * d
                        num, den = c.omega * rest, c.den * (c.decay + sum(w for *_, w in near))
                        step = abs(num) // den * (1 if num > 0 else -1)
                        dev[a, i, j] = d + step
                        top = max(top, abs(step))
        size = max(abs(int(x)) for x in dev.reshape(-1))
        if top <= max(size, field.FIX) // c.tol_den * c.tol_num:
            return dev.astype(np.int64), n
    return dev.astype(np.int64), c.max_iters


def test_sweep_is_the_sequential_one():
    r = np.random.default_rng(1)
    load = r.integers(-10**9, 10**9, (2, 4, 5))
    warrants = (r.random((2, 4, 5)) < 0.1).astype(int)
    zero = np.zeros_like(load)
    c = field.Coefficients()
    s = field.sweep(load, zero, zero, warrants, zero, c)
    want, iters = sequential_sweep(load, warrants, zero, c)
    assert (s.dev == want).all() and s.iters == iters and s.converged
    assert field.sweep(load, zero, zero, warrants, zero, field.Coefficients(max_iters=1)).capped
    with pytest.raises(field.FieldRefused):
        field.sweep(load * 10**9, zero, zero, warrants, zero, c)
    for bad in (lambda: field.Coefficients(den=100), lambda: field.Dims(1, 1, 1, 1)):
        with pytest.raises(field.FieldRefused):
            bad()


def test_lattice_properties(spark):
    dims, now = field.Dims(4, 6, 8, 10**9), 1_757_000_000_000_000_000
    cells = spark.range(400).selectExpr("id AS cell", "id % 4 AS seg", "id % 6 AS cls", "100 + 7 * id AS amount_minor", f"CASE WHEN id % 5 = 0 THEN 0 ELSE {now} + (id % 11) * 1000000000 END AS due_ns", "CAST(CASE WHEN id % 13 = 0 THEN 4 ELSE 0 END AS SMALLINT) AS state", "CAST(CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS flags")
    cold = field.projection(cells, now, dims)
    assert len(set(field.conservation(cells, cold))) == 1
    assert len(set(field.conservation(cells, cold.where("slot > 0")))) == 2  # a lost bucket shows
    changed = cells.where("cell % 3 = 0").withColumn("amount_minor", F.col("amount_minor") - 5000)
    after = cells.where("cell % 3 <> 0").unionByName(changed)
    kept = field.merged(cold, field.delta(cells.where("cell % 3 = 0"), changed, now, dims))
    assert field.projection_digest(kept, dims) == field.projection_digest(field.projection(after, now, dims), dims) != field.projection_digest(cold, dims)
    assert field.moved(cells, now, now, dims).isEmpty()
    with pytest.raises(field.FieldRefused):
        field.moved(cells, now, now - 1, dims)
    huge = cells.withColumn("amount_minor", F.lit(2**62))
    with pytest.raises(Exception, match="field_overflow"):
        field.projection(huge, now, dims).collect()


T0, S = 1_757_000_000_000_000_000, 1_000_000_000


def grade(spark, rows, horizons=None):
    names = [c.split()[0] for c in grades.LOG.split(", ")]
    blank = dict.fromkeys(names, 0) | dict.fromkeys(("closed", "reworked", "reopened", "crossed", "cap_hit"), False)
    log = spark.createDataFrame([tuple((blank | {"seq": i, "cls": 1} | r)[n] for n in names) for i, r in enumerate(rows)], grades.LOG)
    h = horizons or {1: grades.Horizons(*[x * S for x in (10, 20, 5, 10, 30, 5, 10)])}
    return {r["pos"]: r["verdict"] for r in grades.decisions(log, h, seq_block=3, ns_block=7 * S).collect()}


def verb(pos, v, at=0, cell=1, **more):
    return {"k": "verb", "pos": pos, "cell": cell, "verb": v, "at_ns": T0 + at * S, "source": 1} | more


def test_grades(spark):
    acts = [verb(1, 1, cell=1), verb(2, 1, cell=2), verb(3, 1, cell=3), verb(4, 1, cell=4), verb(5, 2, cell=5)]
    world = [{"k": "fact", "cell": 1, "at_ns": T0 + 5 * S, "closed": True, "reverses_pos": 99}, {"k": "fact", "cell": 2, "at_ns": T0 + 6 * S, "reverses_pos": 2}, {"k": "fact", "cell": 5, "at_ns": T0 + 7 * S, "reworked": True}, {"k": "fact", "cell": 3, "at_ns": T0 + 15 * S, "reverses_pos": 3}, {"k": "tick", "cell": 0, "at_ns": T0 + 60 * S}]
    assert grade(spark, acts + world) == {1: "right", 2: "wrong", 3: "reversed_late", 4: "right", 5: "wrong"}
    holds = [verb(1, 0, cell=1, due_ns=T0 + 100 * S), verb(2, 0, cell=2, due_ns=T0 + 50 * S), verb(3, 0, cell=3), {"k": "fact", "cell": 1, "at_ns": T0 + 20 * S, "closed": True, "reverses_pos": 99}, {"k": "tick", "at_ns": T0 + 200 * S}]
    assert grade(spark, holds) == {1: "right", 2: "wrong", 3: "ungradable"}
    raised = [verb(1, 4, cell=1, counterfactual=0), verb(2, 4, cell=2, counterfactual=1), verb(3, 4, cell=3), {"k": "human", "verb": 1, "at_ns": T0}, {"k": "fact", "cell": 1, "at_ns": T0 + S, "reverses_pos": 99}, {"k": "fact", "cell": 2, "at_ns": T0 + S, "reverses_pos": 99}, {"k": "tick", "at_ns": T0 + 60 * S}]
    assert grade(spark, raised) == {1: "right", 2: "wrong", 3: "ungradable"}
    fetched = [verb(i, 3, cell=i) for i in (1, 2, 3, 4)] + [{"k": "judgment", "cell": 1, "at_ns": T0 + S, "crossed": True}, {"k": "judgment", "cell": 2, "at_ns": T0 + S, "crossed": True, "cap_hit": True}, {"k": "judgment", "cell": 3, "at_ns": T0 + S}, {"k": "tick", "at_ns": T0 + 60 * S}]
    assert grade(spark, fetched) == {1: "right", 2: "wrong", 3: "wrong", 4: "wrong"}
    assert grade(spark, [verb(1, 1)]) == {1: "ungraded_yet"}


def test_block_windows(spark):
    r = random.Random(4)
    rows = [(i * 3, r.choice([None, r.randrange(100)])) for i in range(80)]
    frame = spark.createDataFrame(rows, "o long, v long")
    top, last, want = None, None, {}
    for o, v in rows:
        top = v if top is None else top if v is None else max(top, v)
        last = last if v is None else v
        want[o] = (top, last)
    got = running_last(running_max(frame, "o", F.col("v"), "top", 20), "o", F.col("v"), "last", 20)
    assert {x["o"]: (x["top"], x["last"]) for x in got.collect()} == want
    points = sorted(r.sample(range(300), 6))
    marks = spark.createDataFrame([(p, p * 10) for p in points], "p long, c long")
    got = next_above(frame, "o", marks, "p", "c", "n", 20)
    assert {x["o"]: x["n"] for x in got.collect()} == {o: next((p * 10 for p in points if p > o), None) for o, _ in rows}


def test_ordered_folds(spark):
    rows = [("a", i, i * S // 2) for i in range(10)] + [("b", 99, 0)]
    frame = spark.createDataFrame(rows, "by string, seq long, t_ns long")
    got = {(x["by"], x["seq"]): x["admitted"] for x in token_bucket(frame, 1.0, 2.0).collect()}
    assert [got["a", i] for i in range(10)] == [True, True, True, False, True, False, True, False, True, False] and got["b", 99]
    windows = coalesced_refusals(frame.withColumnRenamed("t_ns", "now_ns"), S, ["by"]).where("by = 'a'").orderBy("first_seq").collect()
    assert [(x["n"], x["role"]) for x in windows] == [(1, "opener"), (2, "pending")] * 3 + [(1, "opener")]


def test_facts_fold_state(spark):
    rows = [(i + 1, 0, i * S, i % 3, 1, p, 10 * i, 0, 0, 0) for i, p in enumerate([5, 5, 5, 7, 4, 5, 7, 9, 1])]
    frame = spark.createDataFrame(rows, "pos long, idx int, t_epoch_ns long, cell long, cls long, source_pos long, amount_minor long, due_ns long, state short, flags short")
    judged = state.admitted(frame)
    assert [x["verdict"] for x in judged.orderBy("pos").collect()] == ["applied", "applied", "applied", "applied", "stale_source", "dup", "dup", "applied", "stale_source"]
    again = state.cells_of(state.admitted(state.delivered_once(frame.unionByName(frame))))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, state.cells_of(judged).collect()))


def test_blocks_of_designed_folds_are_nothing_to_see(spark):
    """Kappa, allocation, search and the digest of grades give the same in blocks of any size."""
    r = random.Random(9)
    events = spark.createDataFrame([(i % 3, i, r.randrange(2), r.randrange(2)) for i in range(0, 700, 2)], "cls long, seq long, created long, removed_confirmed long")
    whole = sorted(map(str, designed.kappa(events, 40).collect()))
    assert whole == sorted(map(str, designed.kappa(events, 40, block=40).collect())) == sorted(map(str, designed.kappa(events, 40, block=97).collect())) and len(whole) == 350
    last = [(i, sum(c for k, j, c, _ in map(tuple, events.collect()) if k == i % 3 and i - 40 <= j <= i)) for i in range(0, 700, 2)]
    assert sorted((x.seq, x.created) for x in designed.kappa(events, 40, block=64).collect()) == last
    asks = spark.createDataFrame([(i, i % 2, i % 5 == 0, r.choice([5, 50, 500]), r.randrange(9), 60) for i in range(200)], "ask_id long, period long, pool boolean, value long, cost long, budget long")
    one = sorted(map(str, designed.allocated(asks).collect()))
    assert one == sorted(map(str, designed.allocated(asks, width=7).collect())) and any("granted=True" in x for x in one) and any("granted=False" in x for x in one)
    vectors = spark.createDataFrame([(i, [float(r.randrange(-3, 4)) for _ in range(8)]) for i in range(90)] + [(500, None), (501, [0.0] * 8)], "vec_id long, embedding array<double>")
    some = vectors.where("vec_id % 9 = 0")
    assert sorted(map(str, designed.nearest(vectors, some).collect())) == sorted(map(str, designed.nearest(vectors, some, cell_bytes=200).collect()))
    graded = spark.createDataFrame([(i, i + 1, 7, 1, i % 5, "right" if i % 3 else "wrong", i * 10) for i in range(50)], "seq long, pos long, cell long, cls long, verb int, verdict string, graded_at_ns long")
    assert grades.grades_digest(graded, 16) == grades.grades_digest(graded.repartition(5, "verdict"), 16) != grades.grades_digest(graded.where("seq <> 30"), 16)


def test_attempts_digested_by_column_are_the_transactors(spark):
    request = Request("c", "r", [fact("k", 5, 7)], by="seat:a")
    f = request.facts[0]
    parts = [request.client_id, request.request_id, request.by, f.source, f.table, f.key, f.op, str(f.source_pos)]
    assert spark.range(1).select(attempt_digest_column(*map(F.lit, parts))).first()[0] == attempt_digest(request)
