"""Language-model scores by deleted interpolation of word bigrams, unigrams and a uniform floor.

P(w | h) = l2 c(h, w) / c(h) + l1 c(w) / N + l0 / (V + 1), with weights by bucket of the context's frequency c(h).
Counts for scoring come from all training documents. For the weights one residue of them is deleted: the
others give the estimates, and expectation-maximisation finds the weights under which the deleted part is
likeliest. It runs on the counts of what the deleted tokens look like: the context's bucket, c(h, w) / c(h) and
c(w), in steps of an eighth of an octave, so on a table whose size doesn't follow the corpus.

Nothing of the corpus is gathered in one place. Batches of documents send their distinct words and bigrams
with counts to buckets by hash; a bucket adds them up and answers each batch with what it asked for. Words and
bigrams are told apart by 64 bits. A batch has work and rows for the buckets that it has keys of only, so never more
than it has distinct keys, however many buckets there are. Each context bucket's weights are fitted by a task of
their own. The plan is one: documents and answers are each shuffled once, and the exchanges are used again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._blobs import by_bucket, mixed, pack_sorted, unpack_sorted
from ._runtime import Kept, frugal, frugal_group, partitions, prepare, text_bytes, text_of

#: crc32 of the id modulo FOLDS: HELD_OUT isn't learned from, DELETED fits the weights.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
STEPS = 8
ROUNDS = 60
#: Buckets of contexts: unseen ones, then by octave of the frequency.
CONTEXTS = 64
KEPT, GONE, HELD = 0, 1, 2

_END = np.uint64(xxhash.xxh3_64_intdigest(b"\n</s>"))
_START = np.uint64(xxhash.xxh3_64_intdigest(b"\n<s>"))
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_words = Kept(xxhash.xxh3_64_intdigest)


def fold(id_col: str | Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


class Tokens:
    """The tokens of a batch's texts, an end after each text, as places in sorted distinct words and bigrams."""

    def __init__(self, texts: list[bytes]):
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.lower().split()
            sizes[i] = len(words) + 1
            parts.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
            parts.append(np.array([_END]))
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        ends = np.cumsum(sizes)
        before = np.append(_START, tokens[:-1]) if len(tokens) else tokens
        before[ends[:-1]] = _START
        self.sizes, self.doc = sizes, np.repeat(np.arange(len(texts)), sizes)
        self.words, place = np.unique(np.append(tokens, _START), return_inverse=True)
        place = place.astype(np.int32)
        self.place, start = place[:-1], place[-1]
        self.before = np.append(start, self.place[:-1])
        self.before[ends[:-1]] = start
        self.before = self.before[: len(tokens)]
        self.starts, self.texts = start, len(texts)
        self.bigrams, pair = np.unique(mixed(before * _FIRST + mixed(tokens * _SECOND)), return_inverse=True)
        self.pair = pair.astype(np.int32)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        words = np.bincount(self.place, minlength=len(self.words))
        words[self.starts] = self.texts
        return words, np.bincount(self.pair, minlength=len(self.bigrams))


def pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each count; those from 255 on follow with their places."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), np.stack([large, counts[large]], axis=1).astype("<i8").tobytes()


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    rest = np.frombuffer(large, "<i8").reshape(-1, 2)
    counts[rest[:, 0]] = rest[:, 1]
    return counts


ASKED = "batch long, bucket long, words binary, word_counts binary, word_large binary, bigrams binary, bigram_counts binary, bigram_large binary"
ANSWER = "batch long, bucket long, word_counts binary, word_large binary, bigram_counts binary, bigram_large binary, kept_words binary, kept_words_large binary, kept_bigrams binary, kept_bigrams_large binary"



def _arrow(schema: str, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema.split(", "))
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.table({c.split()[0]: pa.array(v, kinds[c.split()[1]]) for c, v in zip(schema.split(", "), columns, strict=True)})


def _asked(rows: pa.Table, buckets: int) -> pa.Table:
    tokens = Tokens(rows.column("text").to_pylist())
    batch = rows.column("batch")[0].as_py()
    none = (b"", b"")
    parts: dict[int, list] = {}
    for k, (keys, counts) in enumerate(zip((tokens.words, tokens.bigrams), tokens.counts(), strict=True)):
        order, used, cuts = by_bucket(keys, buckets)
        for i, b in enumerate(used.tolist()):
            at = order[cuts[i] : cuts[i + 1]]
            own = parts.setdefault(b, [pack_sorted(keys[:0]), none, pack_sorted(keys[:0]), none])
            # In a bucket a key is told by its quotient.
            own[2 * k : 2 * k + 2] = pack_sorted(keys[at] // np.uint64(buckets)), none if batch % 3 == HELD else pack_counts(counts[at])
    return _arrow(ASKED, [(batch, b, words, *n, bigrams, *m) for b, (words, n, bigrams, m) in parts.items()])


def _added(keys: list[np.ndarray], counts: list[np.ndarray], batches: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    every = np.concatenate(keys)
    distinct, place = np.unique(every, return_inverse=True)
    kind = np.repeat(np.array(batches) % 3, [len(k) for k in keys])
    number = np.concatenate([c if len(c) else np.zeros(len(k), np.int64) for k, c in zip(keys, counts, strict=True)])
    both = np.bincount(place, weights=number, minlength=len(distinct))
    kept = np.bincount(place, weights=np.where(kind == KEPT, number, 0), minlength=len(distinct))
    return distinct, place, both.astype(np.int64), kept.astype(np.int64)


def _answers(rows: pa.Table, buckets: int) -> pa.Table:
    """For each batch of a bucket its counts; the bucket's totals stand in a row with a batch below 0."""
    data = rows.to_pydict()
    batches, bucket = data["batch"], data["bucket"][0]
    counted = lambda kind: [unpack_counts(a, b) for a, b in zip(data[f"{kind}_counts"], data[f"{kind}_large"], strict=True)]
    words = [unpack_sorted(x) for x in data["words"]]
    pairs = [unpack_sorted(x) for x in data["bigrams"]]
    distinct, word_at, word_n, word_kept = _added(words, counted("word"), batches)
    _, pair_at, pair_n, pair_kept = _added(pairs, counted("bigram"), batches)
    own = distinct != _START // np.uint64(buckets) if bucket == int(_START) % buckets else np.ones(len(distinct), bool)
    totals = [int(x) for x in (word_n[own].sum(), (word_n[own] > 0).sum(), word_kept[own].sum(), (word_kept[own] > 0).sum())]
    out = [(-1 - bucket % CONTEXTS, bucket, np.array(totals, "<i8").tobytes(), *[b""] * 7)]
    i = j = 0
    for batch, w, p in zip(batches, map(len, words), map(len, pairs), strict=True):
        a, b = word_at[i : i + w], pair_at[j : j + p]
        i, j = i + w, j + p
        more = (*pack_counts(word_kept[a]), *pack_counts(pair_kept[b])) if batch % 3 == GONE else (b"", b"", b"", b"")
        out.append((batch, bucket, *pack_counts(word_n[a]), *pack_counts(pair_n[b]), *more))
    return _arrow(ANSWER, out)


def _told(keys: np.ndarray, buckets: int, answers: dict[int, dict], kind: str) -> np.ndarray:
    order, used, cuts = by_bucket(keys, buckets)
    counts = np.zeros(len(keys), np.int64)
    small, large = kind, kind.replace("_counts", "_large") if "counts" in kind else f"{kind}_large"
    for i, b in enumerate(used.tolist()):
        row = answers[b]
        counts[order[cuts[i] : cuts[i + 1]]] = unpack_counts(row[small], row[large])
    return counts


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then by octave."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


CELLS = "context long, cell long, n long"


def _cells(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """What the deleted tokens look like to the kept counts."""
    if not answers.num_rows or rows.column("batch")[0].as_py() % 3 != GONE:
        return _arrow(CELLS, [])
    tokens = Tokens(rows.column("text").to_pylist())
    told = {r["bucket"]: r for r in answers.to_pylist()}
    words, pairs = _told(tokens.words, buckets, told, "kept_words"), _told(tokens.bigrams, buckets, told, "kept_bigrams")
    context, word, pair = words[tokens.before], words[tokens.place], pairs[tokens.pair]
    octaves = lambda x: np.round(STEPS * np.log2(x)).astype(np.int64)
    ratio = np.where(pair > 0, 1 + np.maximum(0, octaves(np.maximum(context, 1) / np.maximum(pair, 1))), 0)
    often = np.where(word > 0, 1 + octaves(np.maximum(word, 1)), 0)
    cell, n = np.unique((context_bucket(context) << 32) + (ratio << 16) + often, return_counts=True)
    return pa.table({"context": pa.array(cell >> 32), "cell": pa.array(cell), "n": pa.array(n)})


def context_weights(cells: np.ndarray, n: np.ndarray, total: int, distinct: int, unseen: bool, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of bigram, unigram and floor for the contexts of one bucket, by expectation-maximisation. After an ``unseen`` context there is no bigram."""
    ratio, often = (cells >> 16) & 0xFFFF, cells & 0xFFFF
    p = np.zeros((len(cells), 3))
    p[:, 0] = np.where(ratio > 0, 2.0 ** (-(ratio - 1) / STEPS), 0)
    p[:, 1] = np.where(often > 0, 2.0 ** ((often - 1) / STEPS) / max(1, total), 0)
    p[:, 2] = 1 / (distinct + 1)
    weights = np.array([0, 0.5, 0.5]) if unseen else np.full(3, 1 / 3)
    for _ in range(rounds):
        part = p * weights
        part *= (n / part.sum(axis=1))[:, None]
        # One pseudo-count for each keeps a weight above 0, so no text has probability 0.
        new = part.sum(axis=0) + np.array([0 if unseen else 1, 1, 1])
        weights = new / new.sum()
    return weights


def mixture_weights(cells: np.ndarray, n: np.ndarray, total: int, distinct: int, rounds: int = ROUNDS) -> np.ndarray:
    """Those of all CONTEXTS buckets. Buckets without deleted tokens follow the one below that has some, if there is one."""
    return _followed({int(b): context_weights(cells[cells >> 32 == b], n[cells >> 32 == b], total, distinct, b == 0, rounds) for b in np.unique(cells >> 32)})


def _followed(fitted: dict[int, np.ndarray]) -> np.ndarray:
    none = np.zeros(0, np.int64)
    weights = np.stack([context_weights(none, none, 0, 0, b == 0, 1) for b in range(CONTEXTS)])
    last = None
    for b in range(CONTEXTS):
        if b in fitted:
            weights[b] = fitted[b]
            last = b if b else None
        elif last is not None:
            weights[b] = weights[last]
    return weights


FITTED = "context long, n long, v long, seen boolean, bigram double, unigram double, floor double"


def _fitted(rows: pa.Table) -> pa.Table:
    """The weights of a context bucket, from its cells; the totals are cells below 0."""
    cell, n = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
    context = rows.column("context")[0].as_py()
    totals = dict(zip(cell[cell < 0].tolist(), n[cell < 0].tolist(), strict=True))
    real = cell >= 0
    found = context_weights(cell[real], n[real].astype(float), totals.get(-3, 0), totals.get(-4, 0), context == 0)
    return _arrow(FITTED, [(context, totals.get(-1, 0), totals.get(-2, 0), bool(real.any()), *found.tolist())])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    tokens = Tokens(rows.column("text").to_pylist())
    told = {r["bucket"]: r for r in answers.to_pylist()}
    model = np.frombuffer(told.pop(-1)["word_counts"], "<f8").reshape(CONTEXTS, 6)
    total, distinct = (int(x) for x in model[0, :2].view("<i8"))
    weights = _followed({b: row[3:] for b, row in enumerate(model) if row[2]})
    words, pairs = _told(tokens.words, buckets, told, "word_counts"), _told(tokens.bigrams, buckets, told, "bigram_counts")
    context, word, pair = words[tokens.before], words[tokens.place], pairs[tokens.pair]
    by_doc = lambda x: np.bincount(tokens.doc, weights=x, minlength=tokens.texts)
    base = by_doc(np.log10((word + 1) / (total + distinct + 1)))
    own = weights[context_bucket(context)]
    p = own[:, 0] * (pair / np.maximum(context, 1)) + own[:, 1] * (word / max(1, total)) + own[:, 2] / (distinct + 1)
    held = rows.column("batch")[0].as_py() % 3 == HELD
    n = tokens.texts
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "held_out": pa.array([held] * n),
            "n_tokens": pa.array(tokens.sizes),
            "n_known": pa.array(by_doc(word > 0).astype(np.int64)),
            "train_tokens": pa.array([total] * n, pa.int64()),
            "base_score": pa.array(base),
            "score": pa.array(by_doc(np.log10(p))),
        }
    )


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    A-Z is lower-cased; tokens are words parted by ASCII white space, then one end. Null text counts as empty
    and has its end. A null id counts as the empty text for the fold. Repeated rows are learned from and
    scored as often as given; other columns are ignored. Without training rows N and V are 0 and scores are
    those of the floor. A very long text is in one batch, as a whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    total = text_bytes(docs, text_col)
    each = [max(1, -(-total * share // (FOLDS * batch_bytes))) for share in (FOLDS - 2, 1, 1)]
    buckets = max(partitions(spark), -(-total // bucket_bytes))
    rest = fold(id_col)
    kind = F.when(rest == HELD_OUT, HELD).when(rest == DELETED, GONE).otherwise(KEPT)
    count = F.when(kind == KEPT, each[KEPT]).when(kind == GONE, each[GONE]).otherwise(each[HELD])
    # The fold is by crc32, so the batch must be by another hash.
    rows = docs.select((F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), count) * 3 + kind).cast("long").alias("batch"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    by_batch = rows.groupBy("batch")
    asked = by_batch.applyInArrow(frugal_group(lambda t: _asked(t, buckets)), ASKED)
    answers = asked.groupBy("bucket").applyInArrow(frugal_group(lambda t: _answers(t, buckets)), ANSWER)
    own = answers.repartition(partitions(spark), "batch")
    cells = by_batch.cogroup(own.groupBy("batch")).applyInArrow(frugal_group(lambda t, a: _cells(t, a, buckets) if t.num_rows else _totals(a)), CELLS)
    table = cells.groupBy("context", "cell").agg(F.sum("n").alias("n"))
    fitted = table.groupBy("context").applyInArrow(_fitted, FITTED)
    # One row of CONTEXTS entries; every batch gets it.
    model = fitted.groupBy().applyInArrow(_packed_model, "model binary")
    batches = F.concat(*[F.sequence(F.lit(k).cast("long"), F.lit(3 * (e - 1) + k).cast("long"), F.lit(3).cast("long")) for k, e in enumerate(each)])
    blank = F.lit(b"")
    to_all = model.select(F.explode(batches).alias("batch"), F.lit(-1).cast("long").alias("bucket"), F.col("model").alias("word_counts"), *[blank.alias(c.split()[0]) for c in ANSWER.split(", ")[3:]])
    right = own.unionByName(to_all)
    return by_batch.cogroup(right.groupBy("batch")).applyInArrow(frugal_group(lambda t, a: _scored(t, a, buckets) if t.num_rows else _arrow_scored()), SCORED)


def _packed_model(rows: pa.Table) -> pa.Table:
    """For each context bucket N and V (as integers), whether it was fitted, and its weights."""
    out = np.zeros((CONTEXTS, 6))
    for r in rows.to_pylist():
        out[r["context"], :2] = np.array([r["n"], r["v"]], "<i8").view("<f8")
        out[r["context"], 2:] = r["seen"], r["bigram"], r["unigram"], r["floor"]
    return pa.table({"model": pa.array([out.tobytes()], pa.binary())})


def _totals(answers: pa.Table) -> pa.Table:
    """The totals' rows (batches below 0) as cells -1 to -4 of every context bucket."""
    sums = np.zeros(4, np.int64)
    for blob, batch in zip(answers.column("word_counts").to_pylist(), answers.column("batch").to_pylist(), strict=True):
        if batch < 0:
            sums += np.frombuffer(blob, "<i8")
    return _arrow(CELLS, [(b, -1 - i, int(n)) for b in range(CONTEXTS) for i, n in enumerate(sums)])


def _arrow_scored() -> pa.Table:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in SCORED.split(", ")})
