"""Suffix-array dedup: removes bytes covered by strings of ``LENGTH`` bytes that start earlier elsewhere.

Only suffixes that can matter are sorted. Every window of 100 bytes chooses the least hash of its 51 strings
of 50 bytes, so equal windows choose equal strings at equal offsets; the chosen places are the anchors, about
one in 25 bytes. The steps, over batches of documents and buckets of anchor hashes:

1. batch: find the anchors; send each distinct (hash, context digest) once to its hash's bucket. A context is
   the 50 bytes before and the 100 after an anchor: all windows that chose it lie inside.
2. bucket: answer which hashes occur again, and which of them in several contexts.
3. batch: of each repeated (hash, context), send the first place; later ones are repeats by that already. Only
   hashes with several contexts send the bytes.
4. bucket: of equal contexts, all but the first place are repeats. Unequal contexts of a hash are sorted: the
   suffixes to the right of the anchors and, reversed, those to the left, by deep-shallow sorting. Windows at an
   offset are equal if their contexts share enough in both suffix arrays; all but the first place are repeats.
5. batch: cut the repeats out.

What a hot string sends to its bucket is one row for each batch and distinct context, however often it occurs. A batch
has work and rows for the buckets that it has anchors of only. The documents are shuffled by batch once; steps 1, 3
and 5 reuse that exchange.

Contexts of one string that occurs in a single context are taken for equal if the 64-bit hashes of the string and the
63-bit digests of the contexts agree: of 10^12 pairs of unequal ones, one in 10^25 would. Where a string has several
contexts, bytes decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blobs import by_bucket, joined, lengths, mixed, pack, table
from ._runtime import frugal_group, partitions, prepare, text_bytes, text_of
from .deep_shallow import deep_shallow

LENGTH = 100
GRAM = 50
WINDOW = LENGTH - GRAM + 1
#: Bytes of text in a batch, and for each bucket, on average.
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
SEGMENT = 1 << 20
MARGIN = 2 * LENGTH

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 64, GRAM + LENGTH, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A polynomial hash of the GRAM bytes from each place on, by doubling."""
    power, size, total, done = _BYTE[data], 1, None, 0
    base, left = _BASE, GRAM
    while True:
        if left & 1:
            if total is None:
                total, done = power, size
            else:
                n = len(data) - done - size + 1
                total = total[:n] * np.uint64(base) + power[done : done + n]
                done += size
        left >>= 1
        if not left:
            return total
        n = len(data) - 2 * size + 1
        power = power[:n] * np.uint64(base) + power[size : size + n]
        base, size = base * base & _MASK, 2 * size


def sliding(values: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The least (or other extreme) of ``width`` values from each place on."""
    size = 1
    while 2 * size <= width:
        values, size = least(values[:-size], values[size:]), 2 * size
    return least(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Batch:
    """The documents of a batch in the order of (id, text), end to end."""

    def __init__(self, rows: pa.Table):
        texts = rows.column("text").to_pylist()
        ids = np.array(rows.column("rank").to_pylist(), np.int64)
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.ids = ids[self.order]
        self.ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.starts = np.append(0, self.ends[:-1]) if texts else self.ends
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, documents, hashes and context digests of all anchors."""
        found = []
        n = len(self.data)
        with np.errstate(over="ignore"):
            for start in range(0, n, SEGMENT):
                low, high = max(0, start - MARGIN), min(n, start + SEGMENT + MARGIN)
                if high - low < LENGTH:
                    continue
                raw = gram_hashes(self.data[low:high])
                hashes = mixed(raw)
                least = sliding(hashes, WINDOW)
                edge = np.zeros(WINDOW - 1, np.uint64)
                chosen = sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum)
                at = np.flatnonzero(hashes == chosen)
                at = at[(at + low >= start) & (at + low < start + SEGMENT)]
                doc = np.searchsorted(self.ends, at + low, side="right")
                inside = at + low + GRAM <= self.ends[doc]
                at, doc = at[inside], doc[inside]
                left, right = at + low - self.starts[doc], self.ends[doc] - at - low
                whole = (left >= GRAM) & (right >= LENGTH)
                context = np.empty(len(at), np.uint64)
                k = at[whole]
                context[whole] = mixed(mixed(raw[k - GRAM]) + np.uint64(3) * raw[k] + mixed(raw[k + GRAM] ^ np.uint64(_BASE)))
                part = ~whole
                bytes_, sizes = self.contexts(at[part] + low, doc[part])
                context[part] = mixed((bytes_.astype(np.uint64) * _PLACE).sum(axis=1, dtype=np.uint64) + mixed(sizes[:, 0] * np.uint64(1000) + sizes[:, 1]))
                found.append((at + low, doc, hashes[at], context))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        at, doc, hashes, context = (np.concatenate(x) for x in zip(*found, strict=True))
        return at, doc, hashes, context >> np.uint64(1)

    def contexts(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes around the anchors, zero outside the document, and how many are inside on the left and right."""
        left = np.minimum(GRAM, at - self.starts[doc])
        right = np.minimum(LENGTH, self.ends[doc] - at)
        offset = np.arange(-GRAM, LENGTH)
        place = np.clip(at[:, None] + offset, 0, len(self.data) - 1)
        inside = (offset >= -left[:, None]) & (offset < right[:, None])
        return np.where(inside, self.data[place], 0).astype(np.uint8), np.stack([left, right], axis=1).astype(np.uint64)


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (last first, as in lexsort) and where each distinct key begins in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


ANSWER = "batch long, single binary, several binary"
REQUEST = "batch long, bucket long, hashes binary, contexts binary"
CODE = 5  # bytes of a hash that are sent to its bucket; more occurrences than there are cost time only


def _requests(rows: pa.Table, buckets: int) -> pa.Table:
    """Step 1."""
    _, _, hashes, contexts = Batch(rows).anchors()
    order, new = _firsts(contexts, hashes)
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(order))) > 1
    hashes, contexts = hashes[order[first]], contexts[order[first]] * np.uint64(2) + twice.astype(np.uint64)
    by, used, cuts = by_bucket(hashes, buckets)
    code, contexts = hashes[by] >> np.uint64(8 * (8 - CODE)), contexts[by]
    parts = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    batch = rows.column("batch")[0].as_py()
    return table(REQUEST, [[batch] * len(used), used.tolist(), [pack(code[k], CODE) for k in parts], [pack(contexts[k]) for k in parts]])


def _answers(rows: pa.Table) -> pa.Table:
    """Step 2: of each batch, the codes that occur again, and whether in several contexts."""
    blobs = rows.column("hashes").to_pylist()
    code = joined(blobs, CODE)
    seen = joined(rows.column("contexts").to_pylist())
    order, _ = _firsts(seen >> np.uint64(1), code)
    code_o, seen_o = code[order], seen[order]
    start = np.append(True, code_o[1:] != code_o[:-1])
    group = np.cumsum(start) - 1
    size = np.bincount(group)
    often = (size > 1) | (np.bincount(group, weights=(seen_o & np.uint64(1)).astype(float)) > 0)
    change = ~start
    change[1:] &= seen_o[1:] >> np.uint64(1) != seen_o[:-1] >> np.uint64(1)
    several = np.bincount(group, weights=change) > 0
    state = np.zeros(len(code), np.uint8)
    state[order] = (often.astype(np.uint8) + (often & several))[group]
    bucket = rows.column("bucket")[0].as_py()
    out, at = [], 0
    for batch, n in zip(rows.column("batch").to_pylist(), lengths(blobs, CODE).tolist(), strict=True):
        s, c = state[at : at + n], code[at : at + n]
        at += n
        if (s > 0).any():
            out.append((batch, pack((np.unique(c[s == 1]) << np.uint64(24)) + np.uint64(bucket)), pack((np.unique(c[s == 2]) << np.uint64(24)) + np.uint64(bucket))))
    return table(ANSWER, list(zip(*out, strict=True)))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _places(batch: Batch, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return batch.ids[doc], at - batch.starts[doc]


SPAN = "batch long, doc binary, place binary, reach binary"
FIRSTS = "batch long, bucket long, hashes binary, contexts binary, ids binary, doc binary, place binary, sizes binary, bytes binary"


def _first_places(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Step 3. Repeats inside the batch go along to a bucket, for step 5, as a row without hashes."""
    batch = Batch(rows)
    known = [np.sort(joined(answers.column(c).to_pylist())) for c in ("single", "several")]
    at, doc, hashes, contexts = batch.anchors()
    bucket = hashes % np.uint64(buckets)
    key = ((hashes >> np.uint64(8 * (8 - CODE))) << np.uint64(24)) + bucket
    several = _among(key, known[1])
    keep = several | _among(key, known[0])
    at, doc, hashes, contexts, several, bucket = (x[keep] for x in (at, doc, hashes, contexts, several, bucket))
    ids, place = _places(batch, at, doc)
    sizes = np.stack([np.minimum(GRAM, place), np.minimum(LENGTH, batch.ends[doc] - at)], axis=1).astype(np.uint8)
    order = np.lexsort((place, ids, contexts, hashes))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (contexts[order][1:] != contexts[order][:-1]))[: len(order)]
    # Rows that repeat a document have its ids and places; they are no earlier than it.
    run = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][run] if len(order) else order
    later = (ids[order] != ids[head]) | (place[order] != place[head])
    number = rows.column("batch")[0].as_py()
    out = []
    again = order[later & (sizes[order].sum(axis=1) >= LENGTH)]
    if len(again):
        out.append((number, number % buckets, b"", b"", b"", pack(doc[again], 4), pack(place[again], 4), sizes[again].tobytes(), b""))
    firsts = order[~later]
    by, used, cuts = by_bucket(bucket[firsts], buckets)
    firsts = firsts[by]
    for i, b in enumerate(used.tolist()):
        for some in (True, False):
            k = firsts[cuts[i] : cuts[i + 1]]
            k = k[several[k] == some]
            if len(k):
                near = batch.contexts(at[k], doc[k])[0].tobytes() if some else b""
                out.append((number, b, pack(hashes[k]), pack(contexts[k]), pack(ids[k].view(np.uint64)), pack(doc[k], 4), pack(place[k], 4), sizes[k].tobytes(), near))
    return table(FIRSTS, list(zip(*out, strict=True)))


def repeated_offsets(bytes_: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For contexts in order of their places: whether the window that starts so many bytes before the anchor is that of an earlier context of the group."""
    n = len(groups)
    gram = bytes_[:, GRAM : 2 * GRAM]
    head = np.zeros(groups.max() + 1 if n else 0, np.int64)
    head[groups[::-1]] = np.arange(n)[::-1]
    if n and (gram != gram[head[groups]]).any():  # unequal strings of one hash
        groups = np.unique(np.concatenate([groups.astype(">u8").view(np.uint8).reshape(n, 8), gram], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    right, shared_right = deep_shallow(bytes_[:, 2 * GRAM :], groups)
    left, shared_left = deep_shallow(np.ascontiguousarray(bytes_[:, GRAM - 1 :: -1] if GRAM else bytes_), groups)
    out = np.zeros((n, WINDOW), bool)
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(WINDOW):
        class_right[right] = np.cumsum(shared_right < WINDOW - 1 - offset)
        class_left[left] = np.cumsum(shared_left < offset)
        valid = np.flatnonzero((sizes[:, 0] >= offset) & (sizes[:, 1] >= LENGTH - offset))
        key = class_right[valid] * (n + 1) + class_left[valid]
        first = np.unique(key, return_index=True)[1]
        out[valid, offset] = True
        out[valid[first], offset] = False
    return out


def _repeats(rows: pa.Table) -> pa.Table:
    """Step 4: for each batch, documents, anchors and how far the repeats reach to the left and right."""
    data = rows.to_pydict()
    batches = data["batch"]
    out: dict[int, list[tuple]] = {}
    for i, blob in enumerate(data["hashes"]):
        if not blob:
            out.setdefault(batches[i], []).append((data["doc"][i], data["place"][i], data["sizes"][i]))
    count = lengths(data["hashes"], 8)
    some = np.repeat([bool(x) for x in data["bytes"]], count)
    owner = np.repeat(np.arange(len(batches)), count)
    hashes, contexts = joined(data["hashes"]), joined(data["contexts"])
    ids = joined(data["ids"]).view(np.int64)
    used = [bool(x) for x in data["hashes"]]
    doc, place = (joined([b for b, u in zip(data[c], used, strict=True) if u], 4) for c in ("doc", "place"))
    sizes = np.frombuffer(b"".join(b for b, u in zip(data["sizes"], used, strict=True) if u), np.uint8).reshape(-1, 2)
    near = np.frombuffer(b"".join(data["bytes"]), np.uint8).reshape(-1, GRAM + LENGTH)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(hashes):
        order = np.lexsort((place, ids, contexts, hashes))
        new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (contexts[order][1:] != contexts[order][:-1]))
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = (ids[order] != ids[head]) | (place[order] != place[head])
        again = order[later]
        again = again[sizes[again].sum(axis=1, dtype=np.int64) >= LENGTH]
        found.append((again, sizes[again, 0], sizes[again, 1]))
        firsts = order[~later]
        group = np.cumsum(np.append(True, hashes[firsts][1:] != hashes[firsts][:-1])) - 1
        kinds = np.bincount(group, weights=new[~later])
        firsts, group = firsts[kinds[group] > 1], group[kinds[group] > 1]
        if len(firsts):
            by = np.lexsort((place[firsts], ids[firsts], group))
            firsts, group = firsts[by], np.unique(group[by], return_inverse=True)[1]
            row = np.cumsum(some) - 1
            # Rows that repeat a document stand side by side: the first decides for all.
            twin = np.zeros(len(firsts), bool)
            twin[1:] = (group[1:] == group[:-1]) & (ids[firsts][1:] == ids[firsts][:-1]) & (place[firsts][1:] == place[firsts][:-1]) & (contexts[firsts][1:] == contexts[firsts][:-1])
            lead = np.cumsum(~twin) - 1
            own = firsts[~twin]
            offsets = repeated_offsets(near[row[own]], sizes[own], group[~twin])[lead]
            edges = np.diff(offsets.astype(np.int8), prepend=0, append=0, axis=1)
            which, low = np.nonzero(edges == 1)
            _, high = np.nonzero(edges == -1)
            found.append((firsts[which], high - 1, LENGTH - low))
    if found:
        rows_, left, right = (np.concatenate([f[i] for f in found]) for i in range(3))
        by = np.argsort(owner[rows_], kind="stable")
        cuts = np.searchsorted(owner[rows_][by], np.arange(len(batches) + 1))
        reach = np.stack([left, right], axis=1).astype(np.uint8)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            k = by[cuts[i] : cuts[i + 1]]
            out.setdefault(batches[i], []).append((pack(doc[rows_[k]], 4), pack(place[rows_[k]], 4), reach[k].tobytes()))
    names = sorted(out)
    parts = [[b"".join(x[i] for x in out[b]) for b in names] for i in range(3)]
    return table(SPAN, [names, *parts])


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Of UTF-8, the bytes of those characters all of whose bytes are marked."""
    lead = (data & 0xC0) != 0x80
    if not len(data):
        return gone
    return np.minimum.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]


def _cut(rows: pa.Table, spans: pa.Table, characters: bool) -> pa.Table:
    """Step 5."""
    batch = Batch(rows)
    doc, place = (joined(spans.column(c).to_pylist(), 4).astype(np.int64) for c in ("doc", "place"))
    reach = np.frombuffer(b"".join(spans.column("reach").to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
    at = batch.starts[doc] + place if len(doc) else place
    change = np.zeros(len(batch.data) + 1, np.int32)
    np.add.at(change, at - reach[:, 0], 1)
    np.add.at(change, at + reach[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    if characters:
        gone = whole_characters(batch.data, gone)
    kept_data = batch.data[~gone].tobytes()
    kept_ends = np.append(0, np.cumsum(~gone))[batch.ends] if len(batch.ends) else batch.ends
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = batch.starts[batch.starts < batch.ends]
    first[inner] = gone[inner]
    last = gone.copy()
    last[:-1] &= ~gone[1:]
    final = batch.ends[batch.starts < batch.ends] - 1
    last[final] = gone[final]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(batch.ends, starts, side="right")
    cuts = np.searchsorted(owner, np.arange(len(batch.texts) + 1))
    base = batch.starts[owner]
    spans_ = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(stops - base, pa.int64())], names=["start", "stop"]))
    kept = [kept_data[a:b] for a, b in zip([0, *kept_ends[:-1].tolist()], kept_ends.tolist(), strict=False)]
    same = rows.select(["row"]).combine_chunks().take(pa.array(batch.order, pa.int64()))
    return pa.table({"row": same.column("row"), "n_bytes": pa.array(batch.ends - batch.starts, pa.int64()), "spans": spans_, "kept": pa.array(kept, pa.binary())})


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, characters: bool = False, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """row, n_bytes, spans (start and stop of removed bytes) and kept (the other bytes) for every row of ``docs``.

    ``row`` is a struct of the columns ``keep`` (the id alone, if not given). With ``characters`` a character
    goes only if all its bytes do, so kept is UTF-8 again.

    Null text counts as empty. Ids are integers; "earlier" is by (id, start), and a null id comes after all
    others. Rows that repeat an id and text are one document given twice and have equal results; their
    windows are no earlier than their own. Texts of under 100 bytes keep all. A very long text is in one batch, as
    a whole. Columns not named are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    keep = [id_col] if keep is None else keep
    total = text_bytes(docs, text_col)
    batches = max(1, -(-total // batch_bytes))
    buckets = max(1, min(1 << 24, max(partitions(spark), -(-total // bucket_bytes))))
    number = F.col(id_col).cast("long")
    rows = docs.select(
        F.pmod(F.xxhash64(number, F.col(text_col)), F.lit(batches)).alias("batch"),
        F.coalesce(number, F.lit((1 << 63) - 1)).alias("rank"),
        F.struct(*keep).alias("row"),
        text_of(text_col).cast("binary").alias("text"),
    )
    by_batch = rows.groupBy("batch")
    requests = by_batch.applyInArrow(frugal_group(lambda t: _requests(t, buckets)), REQUEST)
    answers = requests.groupBy("bucket").applyInArrow(frugal_group(_answers), ANSWER)
    firsts = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(frugal_group(lambda t, a: _first_places(t, a, buckets)), FIRSTS)
    spans = firsts.groupBy("bucket").applyInArrow(frugal_group(_repeats), SPAN)
    schema = T.StructType([T.StructField("row", docs.select(keep).schema)] + T.StructType.fromDDL("n_bytes long, spans array<struct<start:long,stop:long>>, kept binary").fields)
    return by_batch.cogroup(spans.groupBy("batch")).applyInArrow(frugal_group(lambda t, s: _cut(t, s, characters)), schema)
