"""Quality scores from random-indexing word vectors and a small neural network.

Tokens are words in lower case and what surrounds them: case patterns, runs of one mark, lengths. Each token has a fixed
sparse ternary index vector, drawn by its hash. A token's word vector is its index vector plus the sum of
those of its neighbours in the training texts, all those outside the held-out fold, so tokens of like contexts
lie close together; tokens that aren't among the ``VOCABULARY`` most frequent have a shared index vector only.
Frequencies and sums are whole numbers, added up by tasks. A document is the mean of its tokens' vectors; a
two-layer network gives its logit, and a temperature, fitted on labelled rows that the network has not seen,
makes it a probability.

Network and temperature see ``SAMPLE`` labelled documents of any length, those with the least hash of their id.
Everything fitted has a fixed size; every document is scored by its whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache
from typing import NamedTuple
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blobs import mixed
from ._runtime import frugal, partitions, prepare, text_of

FOLDS, HELD_OUT = 5, 0
SAMPLE = 4000
#: Most words with vectors of their own, by frequency in the training texts; the rest share hashed rows.
VOCABULARY, HASHED = 30_000, 4096
DIMENSION, NONZERO, NEAR = 64, 6, 2
#: Tokens whose pairs are sorted at once, and rows of context sums that go together.
PAIRED, BLOCK = 1 << 19, 64
#: Distinct tokens that a task keeps before it starts anew: some 30 MB. Characters that are parsed together.
KEEP, TOGETHER = 200_000, 1 << 16
#: Buckets of a doubling of the frequency.
STEPS = 64
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 3e-3
#: Standardised inputs are kept within so many deviations, so what the sample lacks can't decide alone.
REACH = 4.0
#: One in so many rows of the sample fits the temperature.
CALIBRATION = 4
THRESHOLD = 0.3

AGAIN = "mark:again"
_tokens = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+").findall
SPACE, LETTER, NUMBER, MARK = range(4)
#: Code points from here on are marks: tags, selectors, private use.
PLANES = 0x33480
#: Bits of a hash that find its place among the words.
SLOTS = 18
_FACTOR = 0x9E3779B97F4A7C15
_LETTERS = [f"{case}{size}" for case in ("lower", "title", "upper") for size in range(5)]


def _shape(token: str) -> str:
    if not token[0].isalpha():
        return "mark:" + token[:2] if not token[0].isdigit() else "digits"
    return ("upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower") + str(min(len(token), 12) // 3)


def _lower(c: str) -> str:
    return low if len(low := c.lower()) == 1 else c


def features(text: str) -> list[str]:
    """The text's tokens in lower case (character by character), each followed by its shape, and by ``AGAIN`` if it is the one before once more."""
    found, before = [], None
    for t in _tokens(text):
        low = "".join(map(_lower, t))
        found += (low, _shape(t)) if t != before else (low, _shape(t), AGAIN)
        before = t
    return found


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its kind, its lower case, whether it is upper case (1) or else cased (2), and whether it is a digit."""
    every = [chr(i) for i in range(PLANES)]
    kinds = {"L": LETTER, "N": NUMBER}
    kind = np.array([kinds.get(category(c)[0], MARK) for c in every], np.uint8)
    kind[[ord(c) for c in regex.findall(r"\s", "".join(every))]] = SPACE
    case = np.array([1 if c.isupper() else 2 if c.islower() or c.istitle() else 0 for c in every], np.uint8)
    return kind, np.array([ord(_lower(c)) for c in every], np.uint64), case, np.array([c.isdigit() for c in every])


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse modulo 2^64."""
    both = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        power = np.full(size, base, np.uint64)
        power[:1] = 1
        both.append(np.multiply.accumulate(power))
    return tuple(both)


class Block(NamedTuple):
    """Tokens of some texts: what they were found in, where they begin and end, hashes of their lower case, codes of their shapes, the place of each one's text, and whether it is the one before once more."""

    text: str
    begin: np.ndarray
    stop: np.ndarray
    hashes: np.ndarray
    shapes: np.ndarray
    of: np.ndarray
    again: np.ndarray


def _found(texts: list[str], of: list[int], tail: tuple[int, str]) -> Block:
    """``tail`` is a token and the place of the text that it ends a part of."""
    text = "\n".join(texts)
    kind, lower, case, digit = _alphabet()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(points < PLANES, points, PLANES - 1)  # an unassigned one, a mark
    kinds = kind[points]
    edge = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])[: len(kinds)])
    ends = np.append(edge[1:], len(kinds))[: len(edge)]
    some = kinds[edge] != SPACE
    begin, stop = edge[some], ends[some]
    factor, back = _powers(max(TOGETHER, 1 << (len(points) + 1).bit_length()))
    total = np.append(np.uint64(0), np.cumsum(lower[points] * factor[: len(points)], dtype=np.uint64))
    size = stop - begin
    hashes = mixed((total[stop] - total[begin]) * back[begin] + mixed(size.astype(np.uint64)))
    own = kinds[begin]
    first = points[begin]
    second = np.where(size > 1, points[np.minimum(begin + 1, len(points) - 1)], 0)
    if len(begin):
        cases = case[points]
        upper = (np.add.reduceat((cases == 1).astype(np.int32), begin) > 0) & (np.add.reduceat((cases == 2).astype(np.int32), begin) == 0) & (size > 1)
    else:
        upper = np.zeros(0, bool)
    shapes = np.where(upper, 10, np.where(case[first] == 1, 5, 0)) + np.minimum(size, 12) // 3
    shapes = np.where(own == LETTER, shapes, np.where(digit[first] & (own == NUMBER), len(_LETTERS), 64 + (first.astype(np.int64) << 21) + second))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    place = np.array(of, np.int64)[np.searchsorted(bounds, begin, side="right")]
    again = np.zeros(len(begin), bool)
    same = 1 + np.flatnonzero((hashes[1:] == hashes[:-1]) & (place[1:] == place[:-1]))
    again[same] = [text[begin[i] : stop[i]] == text[begin[i - 1] : stop[i - 1]] for i in same.tolist()]
    if len(place) and place[0] == tail[0]:
        again[0] = text[begin[0] : stop[0]] == tail[1]
    return Block(text, begin, stop, hashes, shapes, place, again)


def blocks(texts: Iterable[str]) -> Iterator[Block]:
    """The tokens of texts, some ``TOGETHER`` characters at a time; long texts are cut at spaces, so no token is."""
    waiting, of, size, tail = [], [], 0, (-1, "")
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = at + TOGETHER
            while stop < len(text) and (cut := max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))) <= at:
                stop += stop - at
            stop = min(len(text), stop) if stop >= len(text) else cut
            waiting.append(text[at:stop])
            of.append(k)
            size, at = size + stop - at, stop
            if size >= TOGETHER:
                yield (block := _found(waiting, of, tail))
                if len(block.of):
                    tail = int(block.of[-1]), block.text[block.begin[-1] : block.stop[-1]]
                waiting, of, size = [], [], 0
    if waiting:
        yield _found(waiting, of, tail)


def shape_name(code: int) -> str:
    if code <= len(_LETTERS):
        return "digits" if code == len(_LETTERS) else _LETTERS[code]
    first, second = divmod(code - 64, 1 << 21)
    return "mark:" + chr(first) + (chr(second) if second else "")


def token_hashes(words: list[str]) -> np.ndarray:
    """As the hashes of blocks; 0 for what is no token."""
    out = np.zeros(len(words), np.uint64)
    for low in range(0, len(words), 4096):
        found = _found(words[low : low + 4096], list(range(low, min(len(words), low + 4096))), (-1, ""))
        alone = np.bincount(found.of, minlength=len(words))[found.of] == 1
        out[found.of[alone]] = found.hashes[alone]
    return out


class Rows:
    """Rows of features: ``words`` have their own, others what ``rest`` makes of hashes."""

    def __init__(self, words: dict[str, int], rest: Callable[[np.ndarray], np.ndarray]):
        self.words, self.rest = words, rest
        hashes = token_hashes(list(words))
        order = np.argsort(hashes)
        self.known = np.append(hashes[order], np.uint64(0))
        self.rows = np.append(np.array(list(words.values()), np.int64)[order], -1)
        self.base = np.searchsorted(self.known[:-1] >> np.uint64(64 - SLOTS), np.arange(1 << SLOTS, dtype=np.uint64))
        self.probes = int(np.bincount((self.known[:-1] >> np.uint64(64 - SLOTS)).astype(np.int64)).max()) if words else 0
        self.again = self.of_name(AGAIN)

    @cache  # noqa: B019
    def of_name(self, name: str) -> int:
        return self.words[name] if name in self.words else int(self.rest(_hashes([name]))[0])

    def of_tokens(self, block: Block) -> np.ndarray:
        found = self.rest(block.hashes)
        base = self.base[(block.hashes >> np.uint64(64 - SLOTS)).astype(np.int64)]
        for k in range(self.probes):
            at = np.minimum(base + k, len(self.known) - 1)
            hit = (self.known[at] == block.hashes) & (self.rows[at] >= 0)
            found[hit] = self.rows[at[hit]]
        return found

    def of_shapes(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows, and the place of each token's shape among them."""
        codes, place = np.unique(block.shapes, return_inverse=True)
        return np.array([self.of_name(shape_name(c)) for c in codes.tolist()], np.int64), place

    def sequence(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all features in order, and the place of each one's text."""
        shapes, place = self.of_shapes(block)
        rows = np.stack([self.of_tokens(block), shapes[place] if len(place) else place], axis=1).reshape(-1)
        at = 2 * np.flatnonzero(block.again) + 2
        return np.insert(rows, at, self.again), np.insert(np.repeat(block.of, 2), at, block.of[block.again])


def fold(id_col: str | Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def index_parts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of sparse ternary vectors, the same for a hash everywhere."""
    state, places, signs = hashes.astype(np.uint64), [], []
    with np.errstate(over="ignore"):
        for _ in range(NONZERO):
            state = state * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
            x = state >> np.uint64(33)
            places.append((x % np.uint64(DIMENSION)).astype(np.int64))
            signs.append(np.where(x >> np.uint64(20) & np.uint64(1), 1, -1))
    return np.stack(places, axis=1), np.stack(signs, axis=1)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), DIMENSION), np.float32)
    rows = np.arange(len(hashes))
    for place, sign in zip(*(x.T for x in index_parts(hashes)), strict=True):
        out[rows, place] += sign
    return out


class Model(NamedTuple):
    words: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.column("text").slice(at, 64).to_pylist()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a task's texts with their numbers."""
    known, times, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
    shapes: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*names.tolist(), *shapes], pa.string()), pa.array([*times.tolist(), *shapes.values()], pa.int64())], names=["token", "n"])

    for block in blocks(_texts(batches)):
        if again := int(block.again.sum()):
            shapes[AGAIN] += again
        codes, n = np.unique(block.shapes, return_counts=True)
        for code, m in zip(codes.tolist(), n.tolist(), strict=True):
            shapes[shape_name(code)] += m
        fresh, first, n = np.unique(block.hashes, return_index=True, return_counts=True)
        at = np.searchsorted(known, fresh)
        old = np.zeros(len(fresh), bool)
        if len(known):
            old = known[np.minimum(at, len(known) - 1)] == fresh
        times[at[old]] += n[old]
        new, first = at[~old], first[~old]
        text = block.text
        plain = "\u0130" not in text and "\u03a3" not in text  # else lower() isn't character by character
        words = [text[a:b].lower() if plain else "".join(map(_lower, text[a:b])) for a, b in zip(block.begin[first].tolist(), block.stop[first].tolist(), strict=True)]
        known, times = np.insert(known, new, fresh[~old]), np.insert(times, new, n[~old])
        names = np.insert(names, new, np.array([*words, None], object)[:-1])
        if len(known) > KEEP:
            yield told()
            known, times, names = known[:0], times[:0], names[:0]
            shapes.clear()
    yield told()


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in words], np.uint64)


def context_sums(texts: Iterator[str], words: list[str]) -> np.ndarray:
    """For each word the sum of the index vectors of the words within ``NEAR`` places of it, other tokens left out."""
    end = len(words)  # parts the texts
    other = end + 1
    kind = np.uint32 if other * other < 1 << 32 else np.uint64
    rows_of = Rows({t: i for i, t in enumerate(words)}, lambda hashes: np.full(len(hashes), other))
    places, signs = index_parts(_hashes(words))
    sums = np.zeros(len(words) * DIMENSION)

    def add(ids: np.ndarray) -> None:
        """The pairs that begin at all but the last ``NEAR`` places."""
        for low in range(0, len(ids) - NEAR, PAIRED):
            high, codes = min(len(ids) - NEAR, low + PAIRED), []
            for step in range(1, NEAR + 1):
                a, b = ids[low:high], ids[low + step : high + step]
                some = (a < end) & (b < end)
                codes.append(a[some] * kind(end + 1) + b[some])
            pairs, n = np.unique(np.concatenate(codes), return_counts=True)
            a, b = np.divmod(pairs.astype(np.int64), end + 1)
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    sums[:] += np.bincount(x * DIMENSION + places[y, k], weights=signs[y, k] * n, minlength=len(sums))

    waiting, size, last = [], 0, -1
    for block in blocks(texts):
        rows, of = rows_of.sequence(block)
        known = rows < other
        rows, of = rows[known], of[known]
        if len(rows):
            cuts = np.flatnonzero(np.append(last, of[:-1]) != of)
            waiting.append(np.insert(rows, np.repeat(cuts, NEAR), end).astype(kind))
            size, last = size + len(waiting[-1]), int(of[-1])
        if size >= PAIRED:
            ids = np.concatenate(waiting)
            add(ids)
            waiting, size = [ids[-NEAR:]], NEAR
    if waiting and words:
        add(np.concatenate([*waiting, np.full(NEAR, end, kind)]))
    return sums.reshape(-1, DIMENSION).astype(np.int64)


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(blob), np.int64)
            total[block] = total[block] + part if block in total else part
    yield _blocks(total)


def word_vectors(texts: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Rows of the frequent tokens of a column ``text``, after HASHED rows for all others."""
    spark = texts.sparkSession
    prepare(spark)
    counts = texts.mapInArrow(frugal(_counted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    # Tokens below the bucket of frequencies in which the last place falls are out; a few partitions sort the rest.
    step = F.floor(F.log2("n") * STEPS).alias("step")
    buckets = counts.groupBy(step).agg(F.count(F.lit(1)).alias("tokens"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, left = 1, VOCABULARY
    for bucket in buckets:
        least, left = bucket.least, left - bucket.tokens
        if left <= 0:
            break
    chosen = [r.token for r in counts.where(F.col("n") >= least).repartition(8, "token").orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()]
    counts.unpersist()
    shared = spark.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = context_sums(_texts(batches), shared.value)
        parts = {i: found[i * BLOCK : (i + 1) * BLOCK] for i in range(-(-len(found) // BLOCK))}
        yield _blocks({i: x for i, x in parts.items() if x.any()})

    # A task adds up blocks as they come: its memory is that of the vocabulary.
    summed = texts.mapInArrow(frugal(run), "block int, sums binary").repartition(partitions(spark), "block").mapInArrow(frugal(_added), "block int, sums binary")
    own = index_vectors(np.concatenate([np.arange(HASHED, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), _hashes(chosen)]))
    near = np.zeros(own.shape)
    for r in summed.collect():
        part = np.frombuffer(zlib.decompress(r.sums), np.int64).reshape(-1, DIMENSION)
        near[HASHED + r.block * BLOCK :][: len(part)] = part
    norm = np.linalg.norm(near, axis=1, keepdims=True)
    vectors = own / np.sqrt(NONZERO) + near / np.maximum(norm, 1e-9)
    return {t: HASHED + i for i, t in enumerate(chosen)}, vectors.astype(np.float32)


def _rows(words: dict[str, int]) -> Rows:
    """The rows of a token and of its shape."""
    return Rows(words, lambda hashes: (hashes % np.uint64(HASHED)).astype(np.int64))


def pooled(texts: list[str], vectors: np.ndarray, rows: Rows) -> np.ndarray:
    """Mean word vectors of texts, and the logarithm of the number of tokens; zeros for texts without tokens."""
    total, n = np.zeros((len(texts), DIMENSION + 1)), np.zeros(len(texts))
    for block in blocks(texts):
        if len(block.of):
            starts = np.flatnonzero(np.append(True, block.of[1:] != block.of[:-1]))
            own = block.of[starts]
            each = vectors[rows.of_tokens(block)]
            for k, a, b in zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(each)], strict=True):
                total[k, :-1] += each[a:b].sum(axis=0, dtype=np.float64)
            shapes, place = rows.of_shapes(block)
            which = np.searchsorted(own, block.of)
            times = np.bincount(which * len(shapes) + place, minlength=len(own) * len(shapes)).reshape(len(own), -1)
            again = np.bincount(which, weights=block.again)
            total[own, :-1] += times @ vectors[shapes].astype(np.float64) + again[:, None] * vectors[rows.again]
            n[own] += 2 * times.sum(axis=1) + again
    total[:, :-1] /= np.maximum(n, 1)[:, None]
    total[:, -1] = np.log1p(n)
    return total


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -REACH, REACH)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def logits(model: Model, x: np.ndarray) -> np.ndarray:
    hidden = np.tanh(standard(x, model.mean, model.scale) @ model.w1 + model.b1)
    return hidden @ model.w2 + model.b2


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    return _sigmoid(logits(model, x) / model.temperature)


def _network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Two layers by Adam on the cross-entropy, in batches of 128."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            w1, b1, w2, b2 = params
            hidden = np.tanh(x[at] @ w1 + b1)
            wrong = (_sigmoid(hidden @ w2 + b2) - y[at]) / len(at)
            back = wrong[:, None] * w2 * (1 - hidden**2)
            grads = [x[at].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ wrong + DECAY * w2, wrong.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return params[0], params[1], params[2], float(params[3][0])


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The one of a grid that makes the labels likeliest."""
    grid = np.exp(np.linspace(0, np.log(16), 81))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(words: dict[str, int], vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """Fits network and temperature to pooled rows. Without both labels the score is the share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    blank = Model(words, vectors, np.zeros(DIMENSION + 1), np.ones(DIMENSION + 1), np.zeros((DIMENSION + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)
    held = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    if len(set(y[~held].tolist())) < 2:
        return blank
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0)
    scale = scale + 0.5 * scale.mean() + 1e-3
    w1, b1, w2, b2 = _network(standard(x[~held], mean, scale), y[~held])
    model = Model(words, vectors, mean, scale, w1, b1, w2, b2, 1.0)
    return model._replace(temperature=_temperature(logits(model, x[held]), y[held])) if held.any() else model


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int = SAMPLE) -> DataFrame:
    """doc_id, label and text of at most ``size`` labelled ids outside the held-out fold, by the hash of the id."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != HELD_OUT))
    chosen = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("label") > 0).cast("double").alias("label"), "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", size: int = SAMPLE) -> Model:
    """Texts stay with the tasks; the driver gets the frequent tokens, their context sums and the sample's pooled rows."""
    words, vectors = word_vectors(docs.where(fold(id_col) != HELD_OUT).select(text_of(text_col).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast((words, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, own = shared.value
        rows = _rows(own_words)
        for batch in batches:
            x = np.concatenate([pooled(batch.column("text").slice(at, 64).to_pylist(), own, rows) for at in range(0, batch.num_rows, 64)] or [np.zeros((0, DIMENSION + 1))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    found = sample(docs, labels, id_col, text_col, label_col, size).mapInArrow(frugal(run), "doc_id string, label double, x binary").collect()
    found.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r.doc_id), r.x))
    x = np.frombuffer(b"".join(r.x for r in found)).reshape(-1, DIMENSION + 1)
    return train(words, vectors, x, np.array([r.label for r in found], np.float64))


def with_scores(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row``, a struct of the columns to keep, and the ``score`` of the text, for every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rows = _rows(own.words)
        for batch in batches:
            found = [scores(own, pooled(batch.column("text").slice(at, 64).to_pylist(), own.vectors, rows)) for at in range(0, batch.num_rows, 64)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(found) if found else [], pa.float64())], names=["row", "score"])

    schema = T.StructType([T.StructField("row", docs.select(keep).schema), T.StructField("score", T.DoubleType())])
    return docs.select(F.struct(*keep).alias("row"), text_of(text_col).alias("text")).mapInArrow(frugal(run), schema)


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null text counts as empty; it has no tokens and the score of zero vectors. A null id counts as the empty
    text for the fold. Repeated rows stay; other columns are ignored. Without labels of both kinds every score
    is one share. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    scored = with_scores(rows, model, ["doc_id", "held_out"]).select("row.*", "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
