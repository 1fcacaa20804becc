import base64
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_base64_is_of_the_whole_text(spark, tmp_path):
    r = random.Random(3)
    texts = ["", "a", "é漢字\U0001f600\n\r\t" * 300, *("".join(r.choices("ab é漢\n", k=n)) for n in (49, 50, 51, 57, 5000))]
    texts.append(texts[-1][:-1] + "Z")  # the same but for its end
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.b64_md5, x.b64_length) for x in __spark_entry__.queries()["text_base64"](spark, str(tmp_path)).collect()}
    coded = [base64.b64encode(t.encode()) for t in texts]
    assert got == {i: (hashlib.md5(c).hexdigest(), len(c)) for i, c in enumerate(coded)} | {99: (None, None)}


def test_admission_state_grows_with_the_table(spark, tmp_path):
    """The state is that of the earlier half at every size, and every later event is judged; the SQL says the same."""
    duckdb = pytest.importorskip("duckdb")
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
    for n in (1, 301, 1000):
        events.where(F.col("event_id") < n).coalesce(1).write.parquet(str(tmp_path / str(n) / "events.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{n}/events.parquet/*.parquet'")
        got = __spark_entry__.queries()["admission_middle"](spark, str(tmp_path / str(n))).collect()
        assert sorted(x.seq for x in got) == list(range(n // 2 + 1, n + 1))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(__spark_entry__.oracle_sql()["admission_middle"]).fetchall()))
        reasons = {x.outcome: x.n for x in __spark_entry__.queries()["admission_middle_reasons"](spark, str(tmp_path / str(n))).collect()}
        assert reasons == dict(con.execute(__spark_entry__.oracle_sql()["admission_middle_reasons"]).fetchall()) and sum(reasons.values()) == n - n // 2
    assert any(x.dup or x.reason == "stale_source" for x in got)  # the state is met


def test_conservation_of_totals_beyond_64_bits(spark, tmp_path):
    """No bucket leaves 64 bits, their total may: longs as in the SQL up to the last one, exact decimals beyond."""
    duckdb = pytest.importorskip("duckdb")
    for n, total in enumerate((2**47 - 1, 2**47, 3 * 2**46, -(2**47), -(2**47) - 1)):
        one = total // 2
        rows = [(1, 0, "O", one / 100, "1-URGENT"), (2, 1, "P", (total - one) / 100, "5-LOW"), (3, 2, "F", 1e12, "1-URGENT")]  # the last doesn't contribute
        frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
        frame.withColumn("o_orderdate", F.timestamp_seconds(F.lit(10**9))).coalesce(1).write.parquet(str(tmp_path / str(n) / "orders.parquet"))
        got = __spark_entry__.queries()["lattice_conserved"](spark, str(tmp_path / str(n)))
        fits = -(2**63) <= total * 65536 < 2**63
        assert got.dtypes == [(c, "bigint" if fits else "decimal(38,0)") for c in ("table_fix", "lattice_fix")]
        assert [tuple(map(int, r)) for r in got.collect()] == [(total * 65536,) * 2]
        con = duckdb.connect()
        con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/{n}/orders.parquet/*.parquet'")
        if fits:
            assert con.execute(__spark_entry__.oracle_sql()["lattice_conserved"]).fetchall() == [(total * 65536,) * 2]
        else:
            with pytest.raises(duckdb.ConversionException):
                con.execute(__spark_entry__.oracle_sql()["lattice_conserved"]).fetchall()


def test_ledger_queries_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("events", "documents", "orders", "lineitem"):
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    for name in ("ledger_scan", "ledger_damages", "ledger_breaks", "ledger_status", "ledger_cells", "ledger_resumed", "ledger_caps", "ledger_unreadable", "utf8_offsets", "base64_strict"):
        got = __spark_entry__.queries()[name](spark, SF)
        found = con.execute(__spark_entry__.oracle_sql()[name])
        names = [d[0] for d in found.description]
        want = sorted(map(str, found.fetchall()))
        assert sorted(got.columns) == sorted(names) and len(want) > 0
        assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == want, name
