import os

import pytest

from quillfold.functions.hashing import blake2b_hex, cell_id
from quillfold.functions.jsonlines import Members, Refused, Text, base64_strict, dumps, first_invalid_utf8, scan_string, scan_u64
from quillfold.functions.wire import REQUEST, RESPONSE, decode, encode
from quillfold.operators import verify
from quillfold.plans import snapshot
from quillfold.plans.ledgers import generated_bodies
from quillfold.plans.views import Ledger
from quillfold.sources.tape import BadRow, dump, read_strict, scan_row, scan_tape, segment_name
from quillfold.sources.writer import LedgerBroken, LedgerWriter, build_row, folder_digest, generate, generated_body, replace_file, segments
from quillfold.streaming.tape_stream import TapePartitionReader, TapeStreamReader, TapeStreamSource


def test_hash_vectors():
    assert blake2b_hex(b"") == "0e5751c026e543b2e8ab2eb06099daa1d1e5df47778f7787faab45cdf12fe3a8"
    assert blake2b_hex(b"abc") == "bddd813c634239723171ef3fee98579b94964e3bb1cb3e427262c8c068d52319"
    assert cell_id("a", "b", "c") != cell_id("ab", "", "c")


@pytest.mark.parametrize("raw", [b"carriage\rreturn", b"nul\0inside", b"del\x7f end", b'quote" backslash\\ slash/', b"tab\tnl\nvt\x0b bell\x07", b',"prev":"deadbeef', "✓".encode(), bytes(range(32))])
def test_strings_survive(raw):
    literal = dumps(Text(raw))
    assert scan_string(literal, 0) == (raw, len(literal))
    assert not set(literal) & set(range(32)) and 0x7F not in literal


@pytest.mark.parametrize("raw", [b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5\x80\x80\x80", b"\xe2\x9c", b"\x80"])
def test_invalid_utf8_is_carried_or_refused(raw):
    assert first_invalid_utf8(raw) == 0
    assert dumps(Text(raw)).startswith(b'{"$b64":"')
    with pytest.raises(Refused, match="invalid_utf8"):
        dumps(Text(raw), invalid_utf8="refuse")
    assert first_invalid_utf8("\U0001f680".encode()) is None


def test_writer_refuses():
    for value, reason in ((1.5, "float_forbidden"), (Members([("a", 1), ("a", 2)]), "duplicate_key")):
        with pytest.raises(Refused, match=reason):
            dumps(value)
    with pytest.raises(Refused, match="nonfinite"):
        dumps(float("nan"), floats=True)
    assert scan_u64(b"18446744073709551615,", 0) == (2**64 - 1, 20)
    assert scan_u64(b"18446744073709551616", 0) is None and scan_u64(b"01", 0) is None
    assert base64_strict(b"AAA") is None and base64_strict(b"A=AA") is None and base64_strict(b"AAA=") == b"\0\0"


def test_row_bytes_and_tampering():
    row, h = build_row(42, 1757000000000000000, "tick", 9, 3, "system", b'{"cadence_rule":"r1"}', "0" * 64)
    assert row.startswith(b'{"pos":42,"term":0,"t_epoch_ns":1757000000000000000,"k":"tick","cell":9,"cls":3,"by":"system","body":{"cadence_rule":"r1"},"prev":"')
    assert scan_row(row[:-1]).h == h
    for bad, reason in ((row.replace(b"r1", b"r2"), "hash_mismatch"), (row.replace(b'"pos":42,"term":0', b'"term":0,"pos":42'), "order_pos"), (row[:-3] + b"\n", "bad_tail_width"), (b'{"pos":1}\n', "no_prev_field"), (row.replace(b'"cls":3', b'"cls":4294967296'), "bad_cls")):
        with pytest.raises(BadRow, match=reason):
            scan_row(bad[:-1])
    marked, _ = build_row(0, 1, "tick", 0, 0, "system", dumps({"x": ',"prev":"'}), "0" * 64)
    assert scan_row(marked[:-1]).pos == 0


def test_generator_is_byte_exact(tmp_path):
    writer = generate(str(tmp_path), 5000, 262_144, 16)
    assert folder_digest(str(tmp_path)) == {"digest": "562c6401ea0e4c000110b6e3fac42a1fb96f09dd33688d225eddfed684a9f1f0", "bytes": 1_996_623, "rows": 5008, "segments": 8}
    assert writer.head == "5cfd01539301fb7fab627d2cfdbc68bc1e3415503a713b32ef4aa94b0a155524"


def test_verify_and_damage(spark, tmp_path):
    folder = str(tmp_path)
    writer = generate(folder, 200, 4096, 16)
    found = verify.report(scan_tape(spark, folder), writer.head)
    assert found["ok"] and found["rows"] == writer.next_pos and found["segments"] == len(segments(folder)) > 3
    assert read_strict(spark, folder).count() == found["rows"]
    assert dump(scan_tape(spark, folder, from_pos=50, to_pos=59), kind="tx").count() == dump(scan_tape(spark, folder), 50, 59, "tx").count() > 0
    assert not verify.report(scan_tape(spark, folder), "0" * 64)["ok"]

    path = os.path.join(folder, segment_name(segments(folder)[2]))
    good = open(path, "rb").read()
    open(path, "wb").write(good.replace(b'"amount_cents":', b'"amount_Cents":', 1))
    assert verify.report(scan_tape(spark, folder))["problems"] == {"hash_mismatch": 1, "prev_link": 1, "position": 1}
    open(path, "wb").write(good + b'{"pos":1')
    assert verify.report(scan_tape(spark, folder))["problems"] == {"torn_tail": 1}
    open(path, "wb").write(good)
    # A fork: a later segment that starts its own chain.
    fork, _ = build_row(writer.next_pos, writer.last_stamp + 1, "seg", 0, 0, "system", dumps(Members([("first_pos", writer.next_pos), ("prev_of_first_entry", "0" * 64)])), "0" * 64)
    open(os.path.join(folder, segment_name(writer.next_pos)), "wb").write(fork)
    assert verify.report(scan_tape(spark, folder))["problems"] == {"prev_link": 1, "forked": 1}


def test_a_damaged_ledger_gives_no_answer(spark, tmp_path):
    """A row in the middle that can't be read is an error of every view and snapshot; a torn tail of the last segment isn't."""
    folder = str(tmp_path / "led")
    writer = generate(folder, 200, 4096, 16)
    ledger = Ledger(spark, folder)
    whole = ledger.query("SELECT count(*) AS n FROM tape").first().n
    assert whole == writer.next_pos
    snapshot.take(ledger, 10, str(tmp_path / "snap"))
    last = os.path.join(folder, segment_name(segments(folder)[-1]))
    with open(last, "ab") as f:
        f.write(b'{"pos":9')
    assert ledger.query("SELECT count(*) AS n FROM tape").first().n == whole
    with pytest.raises(Exception, match="torn"):
        read_strict(spark, folder).count()
    path = os.path.join(folder, segment_name(segments(folder)[3]))
    good = open(path, "rb").read()
    for bad, reason in ((good.replace(b'"amount_cents":', b'"amount_Cents":', 1), "hash_mismatch"), (good + b'{"pos":1', "torn")):
        open(path, "wb").write(bad)
        with pytest.raises(Exception, match=reason):
            ledger.query("SELECT count(*) AS n FROM tape").collect()
        with pytest.raises(Exception, match=reason):
            ledger.query("SELECT * FROM cells").collect()
        with pytest.raises(Exception, match=reason):
            ledger.health()
        with pytest.raises(Exception, match=reason):
            snapshot.resume(spark, folder, str(tmp_path / "snap")).collect()


def test_segments_out_of_range_are_not_opened(spark, tmp_path):
    """A segment that can't be read at all doesn't matter to a range that it has no part in."""
    folder = str(tmp_path)
    generate(folder, 400, 4096, 16)
    found = segments(folder)
    low, high = found[4], found[6] - 1
    want = scan_tape(spark, folder).where(f"pos between {low} and {high}").count()
    big = max(os.path.getsize(os.path.join(folder, segment_name(s))) for s in found[4:7])
    for other in (found[1], found[8]):
        with open(os.path.join(folder, segment_name(other)), "ab") as f:
            f.write(b"x" * 3 * big)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 2 * big)
    try:
        assert scan_tape(spark, folder, from_pos=low, to_pos=high).count() == want == high - low + 1
        with pytest.raises(Exception, match="max length"):
            scan_tape(spark, folder).count()
        assert scan_tape(spark, folder, from_pos=high + 1, to_pos=low).count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_recovery_finds_a_last_row_of_any_length(tmp_path):
    """The last row of the segment before the last one is longer than the first windows."""
    folder = str(tmp_path)
    writer = LedgerWriter(folder, 4096, sync=False)
    writer.stage("tick", {"cadence_rule": "x" * 300_000})
    writer.stage("tick", {"cadence_rule": "y"})
    writer.commit()
    assert len(segments(folder)) == 2 and LedgerWriter(folder, 4096).head == writer.head
    path = os.path.join(folder, segment_name(0))
    good = open(path, "rb").read()
    for bad in (good[:-1], good.replace(b"xx", b"xz", 1)):
        open(path, "wb").write(bad)
        with pytest.raises(LedgerBroken):
            LedgerWriter(folder, 4096)


def test_recovery(spark, tmp_path):
    folder = str(tmp_path)
    generate(folder, 100, 1 << 20, 8)
    path = os.path.join(folder, segment_name(0))
    with open(path, "ab") as f:
        f.write(b'{"pos":101,"te')
    ghost = os.path.join(folder, segment_name(500))
    open(ghost, "wb").write(b"half")
    assert verify.status(scan_tape(spark, folder)) == {"ghost_segments": 1, "ghost_bytes": 4, "torn_tail_bytes": 14}
    writer = LedgerWriter(folder)
    assert [w["reason"] for w in writer.warnings] == ["torn_row_discarded", "uncommitted_segment_discarded"]
    assert not os.path.exists(ghost) and verify.report(scan_tape(spark, folder))["ok"]
    os.makedirs(other := os.path.join(folder, "other"))
    open(os.path.join(other, segment_name(0)), "wb").write(b"x" * 300)
    with pytest.raises(LedgerBroken):
        LedgerWriter(other)


def test_a_failed_flush_publishes_nothing(tmp_path):
    def fault(step):
        if step == "write" and writer.next_pos > 1:
            raise OSError("disk")

    writer = LedgerWriter(str(tmp_path), now=lambda: 5)
    writer.fault = fault
    writer.stage("tick", {"cadence_rule": "x"})
    with pytest.raises(OSError):
        writer.commit()
    assert writer.committed_pos == 0
    assert LedgerWriter(str(tmp_path)).committed_pos == 0


@pytest.mark.parametrize("max_bytes", [1, 300, 1000, 4096, 5000, 1 << 20])
def test_capped_reads_lose_nothing(spark, tmp_path, max_bytes):
    """Reads end anywhere in a segment; together they are the scan, and a repeated read gives the same rows."""
    folder = str(tmp_path)
    generate(folder, 200, 4096, 16)
    path = os.path.join(folder, segment_name(segments(folder)[1]))
    with open(path, "ab") as f:
        f.write(b'{"pos":1,"te')  # torn inside the ledger: no row, and no place to stay at
    want = sorted((r.pos, r.seg_first_pos, r.line_no, r.h) for r in scan_tape(spark, folder).where("scan_reason is null").collect())
    reader = TapeStreamReader(folder, max_bytes)
    at, got = reader.initialOffset(), []
    for _ in range(10_000):
        rows, end = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, end)) == rows
        if end == at:
            break
        got, at = got + rows, end
    assert len(segments(folder)) > 3 and sorted((r[0], r[10], r[11], r[9]) for r in got) == want


def test_capped_stream_is_the_scan(spark, tmp_path):
    folder = str(tmp_path / "led")
    os.makedirs(folder)
    generate(folder, 200, 4096, 16)
    spark.dataSource.register(TapeStreamSource)
    stream = spark.readStream.format("quillfold_tape").option("path", folder).option("maxBytes", 9000).load()
    query = stream.writeStream.format("memory").queryName("capped").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.pos for r in spark.table("capped").collect()) == sorted(r.pos for r in scan_tape(spark, folder).collect())


def test_generated_bodies_are_the_generators(spark):
    for row in generated_bodies(spark, "/root/testdata/sf0.001").limit(50).collect():
        assert row.body.encode() == dumps(generated_body(row.event_id))


def test_segments_are_streamed_by_tasks(spark, tmp_path):
    """What is appended between batches comes once, in partitions of one segment; a torn tail waits."""
    folder = str(tmp_path / "led")
    os.makedirs(folder)
    writer = generate(folder, 200, 4096, 16)
    spark.dataSource.register(TapeStreamSource)
    stream = spark.readStream.format("quillfold_tape").option("path", folder).load()
    query = stream.writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    more = LedgerWriter(folder, 4096, sync=False)
    for i in range(50):
        more.stage("tick", {"cadence_rule": f"x{i}"})
    more.commit()
    path = os.path.join(folder, segment_name(segments(folder)[-1]))
    with open(path, "ab") as f:
        f.write(b'{"pos":')
    query.processAllAvailable()
    query.stop()
    want = sorted((r.pos, r.line_no, r.h) for r in scan_tape(spark, folder).where("scan_reason is null").collect())
    assert sorted((r.pos, r.line_no, r.h) for r in spark.table("whole").collect()) == want and len(want) > writer.next_pos
    reader = TapePartitionReader(folder)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [p.first for p in parts] == segments(folder) and reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_pointer_files_are_replaced_whole(tmp_path):
    path = str(tmp_path / "pointer")
    replace_file(path, b"one")
    replace_file(path, b"two, which is longer")
    assert open(path, "rb").read() == b"two, which is longer" and os.listdir(tmp_path) == ["pointer"]
    with pytest.raises(OSError):
        replace_file(str(tmp_path / "nowhere" / "x"), b"")
    os.makedirs(tmp_path / "folder")
    with pytest.raises(OSError):
        replace_file(str(tmp_path / "folder"), b"")
    assert sorted(os.listdir(tmp_path)) == ["folder", "pointer"]


@pytest.mark.parametrize(("layout", "values"), [(REQUEST, {"call": "write", "by": 'a"\\', "arg": "\n", "body": '{"x":[1,"}"]}'}), (REQUEST, {"call": "head"}), (RESPONSE, {"ok": True, "pos": 2**64 - 1, "h": "ab", "info": "\u2713"})])
def test_lines_of_the_protocol_are_strict(layout, values):
    line = encode(layout, values)
    found = decode(layout, line)
    assert {k: v for k, v in found.items() if v} == values
    for bad in (line + b" ", line[:-1], b" " + line, line.replace(b'":', b'": ', 1), line.replace(b'"call"', b'"Call"').replace(b'"ok":', b'"OK":'), b"", b"{}"):
        assert decode(layout, bad) is None
    assert decode(RESPONSE, encode(RESPONSE, {}).replace(b'"pos":0', b'"pos":18446744073709551616')) is None
