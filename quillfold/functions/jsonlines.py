"""The ledger's JSON: a lossless writer and a strict scanner, both over bytes."""

from __future__ import annotations

import base64
import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.schema import INT64_MIN, UINT64_MAX

B64_TAG = "$b64"
_SHORT = {8: b"\\b", 9: b"\\t", 10: b"\\n", 12: b"\\f", 13: b"\\r", 34: b'\\"', 92: b"\\\\"}
_ESCAPES = [_SHORT.get(b) or (b"\\u%04x" % b if b < 0x20 or b == 0x7F else bytes([b])) for b in range(256)]


class Refused(ValueError):
    """The writer or scanner refuses; the text is the reason."""


def first_invalid_utf8(raw: bytes) -> int | None:
    """Where strict UTF-8 breaks, or None."""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start
    return None


def escaped(raw: bytes) -> bytes:
    """A JSON string literal; all control bytes and DEL are escaped."""
    return b'"' + b"".join(map(_ESCAPES.__getitem__, raw)) + b'"'


def dumps(value, *, floats: bool = False, invalid_utf8: str = "carry") -> bytes:
    """One value as JSON bytes. Objects are mappings or lists of (key, value) in order of writing.

    Strings may be str or Text; ``bytes`` are written under a base64 tag, and so are strings that aren't UTF-8,
    unless ``invalid_utf8`` is "refuse". Refuses floats (unless allowed), non-finite ones, and repeated keys.
    """
    if value is None:
        return b"null"
    if value is True or value is False:
        return b"true" if value else b"false"
    if isinstance(value, int):
        if not INT64_MIN <= value <= UINT64_MAX:
            raise Refused("integer_out_of_range")
        return b"%d" % value
    if isinstance(value, float):
        if not floats:
            raise Refused("float_forbidden")
        if not math.isfinite(value):
            raise Refused("nonfinite_float")
        return b"%.17g" % value
    if isinstance(value, str):
        return escaped(value.encode("utf-8"))
    if isinstance(value, Text):
        if first_invalid_utf8(value.raw) is None:
            return escaped(value.raw)
        if invalid_utf8 == "refuse":
            raise Refused("invalid_utf8")
        value = value.raw
    if isinstance(value, bytes):
        return b'{"%s":"%s"}' % (B64_TAG.encode(), base64.b64encode(value))
    again = lambda v: dumps(v, floats=floats, invalid_utf8=invalid_utf8)
    if isinstance(value, Mapping) or isinstance(value, Members):
        pairs = list(value.items() if isinstance(value, Mapping) else value)
        if len({k for k, _ in pairs}) < len(pairs):
            raise Refused("duplicate_key")
        return b"{" + b",".join(again(k) + b":" + again(v) for k, v in pairs) + b"}"
    if isinstance(value, Sequence):
        return b"[" + b",".join(map(again, value)) + b"]"
    raise Refused("unknown_type")


class Text:
    """Bytes that are meant as text."""

    def __init__(self, raw: bytes):
        self.raw = raw


class Members(list):
    """An object as (key, value) pairs."""


_UNESCAPE = {ord('"'): 34, ord("\\"): 92, ord("/"): 47, ord("b"): 8, ord("f"): 12, ord("n"): 10, ord("r"): 13, ord("t"): 9}


def scan_string(raw: bytes, at: int) -> tuple[bytes, int] | None:
    """A string literal from ``at`` on: its bytes and where it ends; only the writer's escapes are known."""
    if raw[at : at + 1] != b'"':
        return None
    at += 1
    out = bytearray()
    while at < len(raw):
        c = raw[at]
        if c == 34:
            return bytes(out), at + 1
        if c < 0x20:
            return None
        if c != 92:
            out.append(c)
            at += 1
            continue
        e = raw[at + 1] if at + 1 < len(raw) else -1
        if e in _UNESCAPE:
            out.append(_UNESCAPE[e])
            at += 2
        elif e == ord("u"):
            digits = raw[at + 2 : at + 6]
            if len(digits) < 4 or not all(x in b"0123456789abcdefABCDEF" for x in digits) or int(digits, 16) >= 0x80:
                return None
            out.append(int(digits, 16))
            at += 6
        else:
            return None
    return None


def scan_u64(raw: bytes, at: int) -> tuple[int, int] | None:
    """Digits from ``at`` on without a leading zero and within 64 bits."""
    end = at
    while end < len(raw) and 48 <= raw[end] <= 57:
        end += 1
    if end == at or raw[at] == 48 and end > at + 1 or end - at > 20 or int(raw[at:end]) > UINT64_MAX:
        return None
    return int(raw[at:end]), end


def scan_value(raw: bytes, at: int) -> int | None:
    """Where the value from ``at`` on ends: nesting is counted, strings are skipped, kinds of brackets aren't told apart."""
    depth, inside, start = 0, False, at
    while at < len(raw):
        c = raw[at]
        if inside:
            if c == 92:
                at += 1
            elif c == 34:
                inside = False
                if depth == 0:
                    return at + 1
        elif c == 34:
            inside = True
        elif c in b"{[":
            depth += 1
        elif c in b"}]":
            if depth == 0:
                return at if at > start else None
            depth -= 1
            if depth == 0:
                return at + 1
        elif c == 44 and depth == 0:
            return at if at > start else None
        at += 1
    return at if at > start and depth == 0 else None


def base64_strict(raw: bytes) -> bytes | None:
    """Padded base64 and nothing else."""
    try:
        found = base64.b64decode(raw, validate=True)
    except ValueError:
        return None
    return found if base64.b64encode(found) == raw else None


def json_string(column: Column) -> Column:
    """String literals of a string column, by the ledger's escapes; all in the JVM.

    Backslashes go first; the other replacements hold none of what comes later.
    """
    out = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    for byte in [*range(0x20), 34, 0x7F]:
        out = F.replace(out, F.lit(chr(byte)), F.lit(_ESCAPES[byte].decode()))
    return F.concat(F.lit('"'), out, F.lit('"'))


def invalid_at(column: Column) -> Column:
    """The offset of the first byte that breaks UTF-8 in a binary column, null if none does."""

    @F.arrow_udf("long")
    def offsets(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else first_invalid_utf8(v) for v in values.to_pylist()], pa.int64())

    return F.when(F.is_valid_utf8(column.cast("string")), F.lit(None).cast("long")).otherwise(offsets(column))


def base64_strict_column(column: Column) -> Column:
    """What padded base64 in a binary column decodes to, null if it is anything else; all in the JVM."""
    text = column.cast("string")
    found = F.try_to_binary(F.when(text.rlike("^[A-Za-z0-9+/]*={0,2}$"), text), F.lit("base64"))
    return F.when(F.regexp_replace(F.base64(found), "\r\n", "") == text, found)
