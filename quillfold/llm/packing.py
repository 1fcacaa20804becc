"""Best-fit packing of tokenised documents under several constraints at once.

A document's ids and one end id make pieces: full ones fill a sequence by themselves, the rest (one at most
for each document, the first) are packed. A sequence has three capacities: tokens, documents, and the cost of
attention inside documents (the sum of squared lengths). Pieces go in order of decreasing length. For each
length all open bins that meet every constraint are scored at once, by the weighted norm of what would be
left or by the weighted dot product of the piece with the residual, and equal pieces fill the bins in the
order of their scores. Pieces are dealt by hash into groups of about ``GROUP`` pieces, packed apart from one
another; each group leaves a few bins underfilled, whatever the size of the corpus.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import checkpointed, frugal, frugal_group, prepare, text_of
from ._vocab import PartWise, packed, rank_encoding

GROUP = 30_000


class Capacities(NamedTuple):
    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024


class Weights(NamedTuple):
    tokens: float = 1.0
    documents: float = 0.01
    cost: float = 0.01


def vector_best_fit(lengths: np.ndarray, capacities: Capacities = Capacities(), weights: Weights = Weights(), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there. ``rule``: norm or dot. Raises if a piece fits no empty bin."""
    lengths = np.asarray(lengths, np.int64)
    cap = np.array(capacities, np.float64)
    weight = np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, n = np.zeros((1024, 3), np.int64), 0
    at = 0
    while at < len(order):
        length = int(lengths[order[at]])
        end = at + int(np.searchsorted(-lengths[order[at:]], -length, side="right"))
        need = np.array([length, 1, length * length], np.int64)
        if (need > np.array(capacities)).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        open_bins = np.flatnonzero((left[:n] >= need).all(axis=1))
        if len(open_bins):
            if rule == "norm":
                score = (((left[open_bins] - need) / cap) ** 2 * weight).sum(axis=1)
            else:
                score = -((left[open_bins] / cap) * (need / cap) * weight).sum(axis=1)
            open_bins = open_bins[np.argsort(score, kind="stable")]
        room = (left[open_bins] // np.maximum(need, 1)).min(axis=1) if length else left[open_bins, 1]
        filled = np.minimum(np.cumsum(room), end - at)
        take = np.diff(filled, prepend=0)
        rest = end - at - int(filled[-1] if len(filled) else 0)
        if rest:
            each = int((np.array(capacities) // np.maximum(need, 1)).min()) if length else capacities.documents
            new = -(-rest // each)
            while n + new > len(left):
                left = np.concatenate([left, np.zeros_like(left)])
            left[n : n + new] = capacities
            open_bins = np.concatenate([open_bins, np.arange(n, n + new)])
            take = np.concatenate([take, np.full(new, each)])
            take[-1] = rest - each * (new - 1)
            n += new
        bins = np.repeat(open_bins, take)
        nth = np.arange(len(bins)) - np.repeat(np.cumsum(take) - take, take)
        which[order[at:end]] = bins
        offset[order[at:end]] = capacities.tokens - left[bins, 0] + nth * length
        left[open_bins] -= take[:, None] * need
        at = end
    return which, offset


class DocumentIds:
    """Ids of a ``tokenizers`` file, by the same vocabulary as ranks; a text with a special token's string goes to ``tokenizers`` itself."""

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        self.path = tokenizer_path
        with open(tokenizer_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        encode = rank_encoding(ranks_path, pattern).encode_ordinary
        self.parts = PartWise(lambda part: packed(encode(part)))

    @cached_property
    def tokenizer(self):
        """Loaded for texts with a special token's string only."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(self.parts(text))


@lru_cache(maxsize=2)
def document_ids(*paths: str) -> DocumentIds:
    return DocumentIds(*paths)


def token_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and end id; only the first piece may be short."""
    prepare(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]
    end = packed([end_id])
    names = ["piece", "start", "length", "ids_crc32"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for at in range(0, batch.num_rows, 64):
                for i, text in enumerate(batch.column("text").slice(at, 64).to_pylist(), at):
                    ids = document_ids(tokenizer_path, ranks_path, pattern)(text) + end
                    n = len(ids) // 4
                    first = n % size or size
                    cuts = [0, *range(first, n + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(i)
                        out.append((k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            values = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, end_id: int = 2, capacities: Capacities = Capacities(), weights: Weights = Weights(), rule: str = "norm", group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of every document.

    Null text is empty and packs its end id. Repeated rows are packed as often as given, in groups by the task
    that read them as well; ids may be null; a very long text is encoded by one task, as a whole;
    other columns are ignored. Sequences have up to ``capacities.tokens`` tokens; those of whole pieces have
    ids from 0, those that were packed have ids below 0. An empty table gives no rows.
    """
    size = capacities.tokens
    pieces = checkpointed(token_pieces(docs, tokenizer_path, ranks_path, pattern, end_id, size, id_col, text_col))
    kind = pieces.dtypes[0][1]
    alone = F.col("length") == size
    whole = pieces.where(alone).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(~alone)
    groups = max(1, -(-short.count() // group))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        which, offset = vector_best_fit(table.column("length").to_numpy(), capacities, weights, rule)
        table = table.drop_columns(["part"])
        ids = -1 - (which + (key[0].as_py() << 32))
        return table.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = short.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(groups)))
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return whole.unionByName(dealt.groupBy("part").applyInArrow(frugal_group(run), columns))
