"""Requests and responses as lines of JSON whose fields stand in a declared order, for files, sockets and streams of them.

A layout is a list of names with kinds: text, u64, flag, or raw, which is a body's own JSON, null if there is none. What
departs from the layout in any byte is refused whole.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.functions.jsonlines import dumps, json_string, scan_string, scan_u64, scan_value

# Fixed values of the protocol: fields in order.
REQUEST = (("call", "text"), ("by", "text"), ("arg", "text"), ("body", "raw"))
RESPONSE = (("ok", "flag"), ("pos", "u64"), ("h", "text"), ("refusal", "text"), ("constraint_id", "text"), ("fault", "text"), ("info", "text"))

Layout = tuple[tuple[str, str], ...]
_KINDS = {"text": "string", "u64": "decimal(20,0)", "flag": "boolean", "raw": "string"}


def encode(layout: Layout, values: dict) -> bytes:
    """Missing values are empty, 0 or false."""
    written = {"text": lambda v: dumps(v or ""), "u64": lambda v: b"%d" % (v or 0), "flag": lambda v: b"true" if v else b"false", "raw": lambda v: (v.encode() if isinstance(v, str) else v) or b"null"}
    return b"{" + b",".join(b'"%s":%s' % (name.encode(), written[kind](values.get(name) or b"" if kind == "raw" else values.get(name))) for name, kind in layout) + b"}"


def _scan(kind: str, line: bytes, at: int) -> tuple[object, int] | None:
    if kind == "text":
        found = scan_string(line, at)
        return found and (found[0].decode("utf-8", "replace"), found[1])
    if kind == "u64":
        return scan_u64(line, at)
    if kind == "flag":
        return next(((word == b"true", at + len(word)) for word in (b"true", b"false") if line.startswith(word, at)), None)
    end = scan_value(line, at)
    if line.startswith(b"null", at):
        return "", at + 4
    return None if end is None else (line[at:end].decode("utf-8", "replace"), end)


def decode(layout: Layout, line: bytes) -> dict | None:
    """The values of a line without its newline, None if it departs from the layout."""
    at, out = 0, {}
    for i, (name, kind) in enumerate(layout):
        label = b'%s"%s":' % (b"," if i else b"{", name.encode())
        if not line.startswith(label, at):
            return None
        found = _scan(kind, line, at + len(label))
        if found is None:
            return None
        out[name], at = found
    return out if line[at:] == b"}" else None


def encoded(layout: Layout, columns: dict[str, Column]) -> Column:
    """Lines of columns that aren't null, in the JVM."""
    written = {"text": json_string, "u64": lambda c: c.cast("string"), "flag": lambda c: F.when(c, "true").otherwise("false"), "raw": lambda c: F.when(c == "", "null").otherwise(c)}
    parts = [x for i, (name, kind) in enumerate(layout) for x in (F.lit(f'{"," if i else "{"}"{name}":'), written[kind](columns[name]))]
    return F.concat(*parts, F.lit("}"))


def decoded(layout: Layout, line: Column) -> Column:
    """A struct of the values of lines (strings or binaries), null for those that depart from the layout."""
    ddl = "struct<" + ", ".join(f"{name}: {_KINDS[kind]}" for name, kind in layout) + ">"

    @F.arrow_udf(ddl)
    def values(lines: pa.Array) -> pa.Array:
        types = {"text": pa.string(), "u64": pa.decimal128(20, 0), "flag": pa.bool_(), "raw": pa.string()}
        out = [None if x is None else decode(layout, x) for x in lines.to_pylist()]
        rows = [None if r is None else {n: Decimal(r[n]) if k == "u64" else r[n] for n, k in layout} for r in out]
        return pa.array(rows, pa.struct([(n, types[k]) for n, k in layout]))

    return values(line.cast("binary"))
