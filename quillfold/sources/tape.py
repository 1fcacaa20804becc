"""The ledger on disk: segments of JSON lines, each row chained to the one before by hash.

``scan_tape`` reads a folder as a DataFrame: one segment is one task's row, scanned strictly line by line, so bare
carriage returns and bytes that aren't UTF-8 survive and a torn tail is seen. Segments have a bounded size. The
scan keeps bad rows with a reason; ``strict`` makes them an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quillfold.functions.hashing import chain_hash
from quillfold.functions.jsonlines import scan_string, scan_u64, scan_value
from quillfold.schema import TAPE

SEGMENT_NAME = r"seg-([0-9]{20})\.jsonl$"
PREV = b',"prev":"'
TAIL = 137
_HEX = re.compile(rb"[0-9a-fA-F]{64}")
_NAME = re.compile(SEGMENT_NAME)
_U32 = (1 << 32) - 1


def segment_name(first_pos: int) -> str:
    return f"seg-{first_pos:020d}.jsonl"


def segment_of(path: str) -> int | None:
    found = _NAME.search(path)
    return int(found[1]) if found else None


@dataclass
class Row:
    pos: int
    term: int
    t_epoch_ns: int
    k: str
    cell: int
    cls: int
    by: str
    body: bytes
    prev: str
    h: str


class BadRow(ValueError):
    """The text is the reason."""


def scan_row(line: bytes, check_hash: bool = True) -> Row:
    """A line without its newline; fields must stand in the writer's order."""
    at = line.rfind(PREV)
    if at < 0:
        raise BadRow("no_prev_field")
    tail = line[at + len(PREV) :]  # 64 digits, then the h field, then the row's end
    if len(tail) != TAIL:
        raise BadRow("bad_tail_width")
    prev = tail[:64]
    if not _HEX.fullmatch(prev):
        raise BadRow("bad_prev")
    if tail[64:71] != b'","h":"':
        raise BadRow("no_h_field")
    h = tail[71:135]
    if not _HEX.fullmatch(h):
        raise BadRow("bad_h")
    if tail[135:] != b'"}':
        raise BadRow("bad_row_end")
    prefix, place = line[:at], 0
    values: dict[str, int | bytes] = {}
    for i, (name, kind) in enumerate((("pos", "u64"), ("term", "u32"), ("t_epoch_ns", "u64"), ("k", "str"), ("cell", "u64"), ("cls", "u32"), ("by", "str"))):
        label = (b"{" if not i else b",") + b'"' + name.encode() + b'":'
        if prefix[place : place + len(label)] != label:
            raise BadRow(f"order_{name}")
        place += len(label)
        found = scan_string(prefix, place) if kind == "str" else scan_u64(prefix, place)
        if found is None or kind == "u32" and found[0] > _U32:
            raise BadRow(f"bad_{name}")
        values[name], place = found
    label = b',"body":'
    if prefix[place : place + len(label)] != label:
        raise BadRow("order_body")
    place += len(label)
    end = scan_value(prefix, place)
    if end is None:
        raise BadRow("bad_body")
    if end != len(prefix):
        raise BadRow("trailing_after_body")
    row = Row(values["pos"], values["term"], values["t_epoch_ns"], values["k"].decode("utf-8", "replace"), values["cell"], values["cls"], values["by"].decode("utf-8", "replace"), prefix[place:end], prev.decode(), h.decode())
    if check_hash and chain_hash(row.prev, prefix) != row.h:
        raise BadRow("hash_mismatch")
    return row


def scanned(line: bytes, first_pos: int, number: int, check_hash: bool = True) -> tuple:
    try:
        r = scan_row(line, check_hash)
    except BadRow as e:
        return (*[None] * 10, first_pos, number, str(e))
    return (r.pos, r.term, r.t_epoch_ns, r.k, Decimal(r.cell), r.cls, r.by, r.body.decode("utf-8", "replace"), r.prev, r.h, first_pos, number, None)


def torn(rest: bytes, first_pos: int, number: int) -> tuple:
    return (len(rest), *[None] * 9, first_pos, number, "torn")


def scan_segment(data: bytes, first_pos: int, check_hash: bool = True) -> Iterator[tuple]:
    """Rows of schema TAPE; a bad line has its reason, and bytes after the last newline are a row "torn" with their number as pos."""
    *lines, rest = data.split(b"\n")
    for number, line in enumerate(lines, 1):
        yield scanned(line, first_pos, number, check_hash)
    if rest:
        yield torn(rest, first_pos, len(lines) + 1)


def scan_lines(lines: DataFrame, keys: list[str], check_hash: bool = True) -> DataFrame:
    """Rows of many ledgers from a table of lines: ``keys`` name the ledger, then seg_first_pos, line_no, line (binary, without its newline) and whole (false for a torn one)."""
    kept = _parse_datatype_string("struct<" + ", ".join(f"`{n}`: {t}" for n, t in lines.select(keys).dtypes) + ">")
    schema = T.StructType([*kept.fields, *_parse_datatype_string(TAPE).fields])
    types = to_arrow_schema(_parse_datatype_string(TAPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, number, line, whole = (batch.column(c).to_pylist() for c in ("seg_first_pos", "line_no", "line", "whole"))
            rows = [scanned(x, f, n, check_hash) if w else torn(x, f, n) for f, n, x, w in zip(first, number, line, whole, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(list(c), t) for c, t in zip(columns, types.types, strict=True))], names=schema.names)

    return lines.select(*keys, "seg_first_pos", "line_no", "line", "whole").mapInArrow(run, schema)


def _names(files: DataFrame) -> list[tuple[int, str]]:
    """First positions and paths of the segments, in order: a listing, which opens no file."""
    found = [(segment_of(r[0]), r[0]) for r in files.select("path").collect()]
    return sorted(x for x in found if x[0] is not None)


def _holding(files: DataFrame, from_pos: int | None, to_pos: int | None) -> list[str]:
    """Paths of the segments that can hold positions of the range."""
    known = _names(files)
    low = max((p for p, _ in known if from_pos is not None and p <= from_pos), default=0)
    return [path for p, path in known if p >= low and (to_pos is None or p <= to_pos)]


class Unreadable(ValueError):
    """A row that a strict scan met."""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "seg-*.jsonl").load(folder)


def _scanned(files: DataFrame, from_pos: int | None, to_pos: int | None, check_hash: bool, may_be_torn: int | None, strict: bool) -> DataFrame:
    if from_pos is not None or to_pos is not None:
        held = _holding(files, from_pos, to_pos)
        files = files.sparkSession.read.format("binaryFile").load(held) if held else files.limit(0)
    first = F.regexp_extract("path", SEGMENT_NAME, 1)
    files = files.where(first != "").select(first.try_cast("long").alias("first_pos"), "content")
    schema = _parse_datatype_string(TAPE)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_pos, content in zip(batch.column("first_pos").to_pylist(), batch.column("content"), strict=True):
                rows = list(scan_segment(content.as_py(), first_pos, check_hash))
                if strict:
                    for *_, line, reason in rows:
                        if reason is not None and not (reason == "torn" and first_pos == may_be_torn):
                            raise Unreadable(f"unreadable row: segment {first_pos} line {line}: {reason}")
                    rows = [r for r in rows if r[-1] is None]
                columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    out = files.select("first_pos", "content").mapInArrow(run, schema)
    bad = F.col("scan_reason").isNotNull()
    if from_pos is not None:
        out = out.where(bad | (F.col("pos") >= from_pos))
    if to_pos is not None:
        out = out.where(bad | (F.col("pos") <= to_pos))
    return out


def scan_tape(spark: SparkSession, folder: str, check_hash: bool = True, from_pos: int | None = None, to_pos: int | None = None) -> DataFrame:
    """The ledger's rows. Positions outside the range are left out; segments that can't hold any aren't opened."""
    return _scanned(_files(spark, folder), from_pos, to_pos, check_hash, None, False)


def read_strict(spark: SparkSession, folder: str, from_pos: int | None = None, to_pos: int | None = None, torn_tail: bool = False) -> DataFrame:
    """All rows of a range, or an error for the first reason that one can't be read, whatever the rows are then filtered by.

    With ``torn_tail`` bytes after the last newline of the last segment are left out: a writer may be at work there.
    """
    files = _files(spark, folder)
    known = _names(files) if torn_tail else []
    return _scanned(files, from_pos, to_pos, True, known[-1][0] if known else None, True)


def dump(tape: DataFrame, from_pos: int = 0, to_pos: int | None = None, kind: str | None = None) -> DataFrame:
    rows = tape.where(F.col("scan_reason").isNull() & (F.col("pos") >= from_pos))
    if to_pos is not None:
        rows = rows.where(F.col("pos") <= to_pos)
    return rows if kind is None else rows.where(F.col("k") == kind)
