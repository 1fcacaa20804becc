"""Numpy arrays in binary columns, and the tables that carry them between batches and buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit integers."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return raw[:, :width].tobytes()


def unpack(blob: bytes, width: int = 8) -> np.ndarray:
    raw = np.zeros((len(blob) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return raw.view("<u8").reshape(-1)


def joined(blobs: list[bytes], width: int = 8) -> np.ndarray:
    return unpack(b"".join(blobs), width)


def lengths(blobs: list[bytes], width: int) -> np.ndarray:
    return np.array([len(b) // width for b in blobs], np.int64)


def table(schema: str, columns: list) -> pa.Table:
    """Columns of longs and binaries, by a DDL schema; a table without rows has its types too."""
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array(values, pa.int64() if kind == "long" else pa.binary()) for (name, kind), values in zip(fields, columns or [[]] * len(fields), strict=True)})


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit integers as differences, of as many bytes as eight times their mean needs; those that need more follow with their places."""
    steps = np.diff(keys, prepend=np.uint64(0))
    mean = int(keys[-1]) // len(keys) if len(keys) else 0
    width = min(8, -(-(8 * mean + 1).bit_length() // 8))
    large = np.flatnonzero(steps >> np.uint64(8 * width)) if width < 8 else np.zeros(0, np.int64)
    return np.array([len(keys), len(large), width], "<u4").tobytes() + pack(steps, width) + large.astype("<u8").tobytes() + steps[large].astype("<u8").tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, m, width = np.frombuffer(blob, "<u4", 3).tolist()
    steps = unpack(blob[12 : 12 + width * n], width)
    large = np.frombuffer(blob, "<u8", 2 * m, 12 + width * n)
    steps[large[:m].astype(np.int64)] = large[m:]
    return np.cumsum(steps, dtype=np.uint64)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket that keeps the keys' own, the buckets that have keys, and where each one's begin and end."""
    bucket = keys % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    return order, bucket[cuts].astype(np.int64), np.append(cuts, len(bucket))
