"""Byte-level BPE by overlapping chunks, and decoding.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, from its own start. The
pattern only looks ahead, so from any common boundary on, the pre-tokens of a chunk are those of the whole
text: neighbours are stitched at the first boundary that both have in their overlap. If there is none, the
earlier chunk is continued from its last sure boundary instead. Pre-tokens are then encoded by rank, each
distinct one once while it is kept. Decoding concatenates the bytes of the ids.

The chunks of a text up to ``SPREAD`` characters are taken by the task that has the text. Those of a longer one are
rows that all tasks share: each is pre-tokenised and encoded where it is, and the text's task only stitches
boundaries and ids.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import KEEP_ENCODED, Kept, frugal, frugal_group, prepare, text_of
from ._vocab import packed, rank_encoding

CHUNK = 8192
OVERLAP = 256
#: Characters from which on a text's chunks are spread over tasks, and of a chunk then.
SPREAD, PART = 1 << 20, 1 << 17
#: Characters behind a pre-token's end that decide about it: a mark may begin a contraction of three.
AHEAD = 3


class ChunkedPattern:
    def __init__(self, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.findall = regex.compile(pattern).findall
        self.chunk, self.overlap = chunk, overlap

    def one_chunk(self, text: str, start: int, stop: int, more: bool | None = None) -> tuple[list[str], list[int]]:
        """Pre-tokens from ``start`` and where each ends; those that what follows ``stop`` might change are left out, if there is ``more``."""
        tokens = self.findall(text[start:stop])
        ends = list(accumulate(map(len, tokens), initial=start))[1:]
        more = stop < len(text) if more is None else more
        while more and ends and ends[-1] > stop - AHEAD:
            tokens.pop()
            ends.pop()
        return tokens, ends

    def pretokens(self, text: str) -> list[str]:
        if len(text) <= self.chunk + self.overlap:
            return self.findall(text)
        starts = range(0, len(text), self.chunk)
        chunks = [self.one_chunk(text, s, min(len(text), s + self.chunk + self.overlap)) for s in starts]
        tokens, ends = chunks[0]
        for start, (more, more_ends) in zip(starts[1:], chunks[1:], strict=True):
            stop = min(len(text), start + self.chunk + self.overlap)
            if ends and ends[-1] >= stop:
                continue
            at = bisect_left(ends, start)
            sure = {e: i for i, e in enumerate(ends[at:], at)}
            joint = next(((sure[e], i) for i, e in enumerate([start, *more_ends]) if e in sure), None)
            if joint is None:
                more, more_ends = self.resumed(text, ends[-1] if ends else 0, stop)
                tokens += more
                ends += more_ends
            else:
                kept, skipped = joint
                del tokens[kept + 1 :], ends[kept + 1 :]
                tokens += more[skipped:]
                ends += more_ends[skipped:]
        return tokens

    def resumed(self, text: str, start: int, stop: int) -> tuple[list[str], list[int]]:
        """Pre-tokens from a sure boundary, over more and more text until one is complete."""
        while True:
            tokens, ends = self.one_chunk(text, start, stop)
            if ends or stop == len(text):
                return tokens, ends
            stop = min(len(text), start + 2 * (stop - start))


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.encoding = rank_encoding(ranks_path, pattern)
        self.pattern = ChunkedPattern(pattern, chunk, overlap)
        self.kept = Kept(lambda token: packed(self.encoding.encode_ordinary(token)), KEEP_ENCODED)
        self.raw = Kept(self.encoding.decode_single_token_bytes)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.kept.__getitem__, self.pattern.pretokens(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def _mapped(docs: DataFrame, of_texts, columns: str, id_col: str, text_col: str, together: int = 64) -> DataFrame:
    """Rows of doc_id and what ``of_texts`` gives for each of some texts; one row for each row of ``docs``."""
    prepare(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for at in range(0, batch.num_rows, together) for x in of_texts(batch.column("text").slice(at, together).to_pylist())]
            values = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=["doc_id", *names])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, {columns}")


PARTS = "row long, part long, start long, last boolean, text string"
ENCODED = "row long, start long, text string, ends binary, sizes binary, ids binary"


def _cut(batches: Iterator[pa.RecordBatch], part: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Overlapping parts of texts, each with the id of its document."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            for k, start in enumerate(range(0, len(text), part)):
                some = text[start : start + part + overlap]
                values = [[batch.column("row")[i].as_py()], [k], [start], [start + len(some) == len(text)], [some]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *map(pa.array, values)], names=["doc_id", *(c.split()[0] for c in PARTS.split(", "))])


def _encoded(batches: Iterator[pa.RecordBatch], bpe: Callable[[], ByteBpe]) -> Iterator[pa.RecordBatch]:
    """Where the pre-tokens of each part end, how many ids each has, and the ids; those that what follows the part might change are left out."""
    for batch in batches:
        ends, sizes, ids = [], [], []
        for text, last in zip(batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True):
            tokens, stops = bpe().pattern.one_chunk(text, 0, len(text), not last)
            own = [bpe().kept[t] for t in tokens]
            ends.append(np.array(stops, "<i8").tobytes())
            sizes.append(np.array([len(x) // 4 for x in own], "<i8").tobytes())
            ids.append(b"".join(own))
        names = ["doc_id", *(c.split()[0] for c in ENCODED.split(", "))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), *(pa.array(x, pa.binary()) for x in (ends, sizes, ids))], names=names)


def _stitched(parts: pa.Table, bpe: ByteBpe) -> bytes:
    """The ids of a text from those of its parts."""
    rows = sorted(zip(*(parts.column(c).to_pylist() for c in ("start", "text", "ends", "sizes", "ids")), strict=True))
    out: list[bytes] = []
    known, kept, ids = np.zeros(1, np.int64), np.zeros(1, np.int64), b""  # sure boundaries, the ids before each, and those ids
    for start, text, ends, sizes, own in rows:
        if known[-1] >= start + len(text):
            continue
        bounds, upto = np.append(start, np.frombuffer(ends, "<i8") + start), np.append(0, np.cumsum(np.frombuffer(sizes, "<i8")))
        joint = np.flatnonzero(np.isin(bounds, known))
        if len(joint):
            at, skipped = int(np.searchsorted(known, bounds[joint[0]])), int(joint[0])
            out.append(ids[: 4 * kept[at]])
            known, kept, ids = bounds[skipped:], upto[skipped:] - upto[skipped], own[4 * upto[skipped] :]
        else:
            whole = "".join(t[: b - a] for (a, t, *_), (b, *_) in zip(rows, rows[1:], strict=False)) + rows[-1][1]
            out.append(ids)
            tokens, stops = bpe.pattern.resumed(whole, int(known[-1]), start + len(text))
            found = [bpe.kept[t] for t in tokens]
            known, kept, ids = np.append(known[-1], np.array(stops, np.int64)), np.append(0, np.cumsum([len(x) // 4 for x in found], dtype=np.int64)), b"".join(found)
    return b"".join([*out, ids])


def _spread(docs: DataFrame, of_ids, columns: str, bpe: Callable[[], ByteBpe], id_col: str, text_col: str, part: int, overlap: int) -> DataFrame:
    """doc_id and what ``of_ids`` makes of a text's ids, the parts of each text encoded side by side."""
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(frugal(lambda it: _cut(it, part, overlap)), f"doc_id {kind}, {PARTS}")
    encoded = parts.repartition("row", "part").mapInArrow(frugal(lambda it: _encoded(it, bpe)), f"doc_id {kind}, {ENCODED}")

    def run(of: pa.Table) -> pa.Table:
        found = of_ids(_stitched(of, bpe()))
        return pa.table({"doc_id": of.column("doc_id")[:1], **{c.split()[0]: [x] for c, x in zip(columns.split(", "), found, strict=True)}})

    return encoded.groupBy("row").applyInArrow(frugal_group(run), f"doc_id {kind}, {columns}")


def _coded(docs: DataFrame, of_ids, columns: str, ranks_path: str, pattern: str, id_col: str, text_col: str, spread: int, part: int, overlap: int) -> DataFrame:
    bpe = lambda: coder(ranks_path, pattern)
    long = F.coalesce(F.length(F.col(text_col)) > spread, F.lit(False))
    near = _mapped(docs.where(~long), lambda texts: [of_ids(bpe().encode(t)) for t in texts], columns, id_col, text_col)
    return near.unionByName(_spread(docs.where(long), of_ids, columns, bpe, id_col, text_col, part, overlap))


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD, part: int = PART, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) for every row of ``docs``.

    Null text counts as empty and has no ids. Ids may be null; repeated rows stay; other columns are ignored. A very
    long text is encoded in parts by many tasks; one task holds its ids. An empty table gives no rows.
    ``ranks_path`` must exist on every worker.
    """
    return _coded(docs, lambda ids: (ids,), "ids binary", ranks_path, pattern, id_col, text_col, spread, part, overlap)


def byte_bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD, part: int = PART, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and, from the ids decoded again, decoded_sha256."""

    def digests(ids: bytes) -> tuple[int, str, str]:
        raw, bpe = hashlib.sha256(), coder(ranks_path, pattern)
        for at in range(0, len(ids), 1 << 20):
            raw.update(bpe.decode(ids[at : at + (1 << 20)]))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), raw.hexdigest()

    return _coded(docs, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", ranks_path, pattern, id_col, text_col, spread, part, overlap)
