"""BLAKE2b and the identities that are made of it; Spark has no such function, so these are Arrow UDFs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def blake2b_hex(data: bytes, size: int = 32) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def chain_hash(prev: str, prefix: bytes) -> str:
    """A row's hash: over the previous row's hash, as hex text, and the row's bytes before its own prev field."""
    return blake2b_hex(prev.encode() + prefix)


def cell_id(source: str, table: str, key: str) -> int:
    """The low 64 bits of a 128-bit hash of the parts, never 0."""
    digest = hashlib.blake2b(SEPARATOR.join((source, table, key)).encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little") or 1


def length_prefixed(parts: Iterable[str | int]) -> bytes:
    """Strings with their lengths, integers as 64 bits, both little-endian, so that no two lists share bytes."""
    out = []
    for p in parts:
        if isinstance(p, str):
            raw = p.encode()
            out += [len(raw).to_bytes(8, "little"), raw]
        else:
            out.append((p & (1 << 64) - 1).to_bytes(8, "little"))
    return b"".join(out)


def pin(domain: str, parts: Iterable[str | int]) -> str:
    """The identity of a declaration: any change of a part moves it."""
    return blake2b_hex(length_prefixed([domain, *parts]))


def blake2b(column: str | Column, size: int = 32) -> Column:
    """Hex BLAKE2b of a string or binary column; null stays null."""

    @F.arrow_udf("string")
    def digests(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else blake2b_hex(v, size) for v in values.to_pylist()], pa.string())

    return digests(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"))


def cell_id_column(source: Column, table: Column, key: Column) -> Column:
    """Cell ids as decimal(20,0); null parts count as empty."""

    @F.arrow_udf("decimal(20,0)")
    def ids(values: pa.Array) -> pa.Array:
        from decimal import Decimal

        found = []
        for v in values.to_pylist():
            digest = hashlib.blake2b(v, digest_size=16).digest()
            found.append(Decimal(int.from_bytes(digest[:8], "little") or 1))
        return pa.array(found, pa.decimal128(20, 0))

    parts = [F.coalesce(x, F.lit("")) for x in (source, table, key)]
    return ids(F.concat_ws(SEPARATOR, *parts).cast("binary"))


def row_digest(df, columns: list[str]) -> tuple[str, int]:
    """An order-independent digest of a table: the XOR of its rows' hashes, hashed with their number.

    Four 64-bit lanes are XORed in the JVM, so only one row comes back. Nulls differ from all values.
    """
    cells = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    text = F.concat(*[F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in cells])
    hashed = df.select(blake2b(text).alias("h"))
    lanes = [F.bit_xor(F.conv(F.substring("h", 1 + 16 * i, 16), 16, -10).cast("long")).alias(f"l{i}") for i in range(4)]
    row = hashed.agg(*lanes, F.count(F.lit(1)).alias("n")).first()
    raw = b"".join(((row[i] or 0) & (1 << 64) - 1).to_bytes(8, "little") for i in range(5))
    return blake2b_hex(raw), row["n"]
