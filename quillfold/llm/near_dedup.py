"""Near-dedup of documents by b-bit MinHash, confirmed on full sets.

1. Every document's set of shingles gives ``PERMUTATIONS`` minima. Bands of ``ROWS`` whole minima make the
   candidate keys; of each minimum the ``BITS`` low bits are kept and packed into a signature.
2. Documents of equal sets are a class; the smallest id stands for it from here on.
3. First round: in each key's group the smallest id leads. Members whose similarity to it, estimated from the bits
   that agree and corrected for chance agreement, may reach the threshold become pairs; the rest go on with the next
   leader, up to ``LEADERS``. So a group of near copies gives about as many pairs as members. A key that
   is frequent in a batch goes to salted groups, and the batch's smallest member to the common one as well.
4. Pairs are confirmed on full sets; components follow from the confirmed links. A leader's set meets those of its
   partners in rows that a task reads one after another; the partners of a leader of a large group are salted by
   their own hash before anything is shuffled by the leader.
5. Second round: keys whose members are still in several components are opened. Their members are gathered by the
   key's largest component, each once, with its full set, and dealt to blocks of a bounded number and size; those
   outside that component are queries, in blocks of their own, and each block of queries meets each block of members.
   Where a query shares a key with a member of another component and the estimate may reach the threshold, the sets
   decide at once, best estimates first, until the two components are linked. So whatever the first round left out,
   by leaders or salts, is made good here, and no pairs leave a task but links.

Pairs inside a component need no further look: they can't change it. A pair at 0.75 shares none of the 32 keys
with a probability of 5e-6, and its estimate falls short of the threshold by 0.17 with one of 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import joined, mixed, pack, unpack
from ._runtime import Kept, checkpointed, frugal, frugal_group, partitions, prepare, text_of
from .components import components

SHINGLE = 5
PERCENT = 75
PERMUTATIONS, ROWS = 128, 4
#: Low bits of a minimum that go with a key, and that the second round sees.
BITS, FINE = 2, 4
BANDS = PERMUTATIONS // ROWS
#: An estimate may be so far below the threshold, by the number of bits.
MARGIN = {BITS: 0.2, FINE: 0.17}
LEADERS = 64
#: A key is frequent in a batch from so many members on; then it goes to one of so many groups.
FREQUENT, SALTS = 64, 64
#: Documents whose keys are dealt together: some 2 MB.
DEALT = 5_000
#: Partners of a leader whose sets one task reads in a row.
PARTNERS = 500
#: Members of a block in the second round, and bytes of their sets on average.
BLOCK, BLOCK_BYTES = 2_000, 16 << 20
#: The largest component of a key, and its members, are matched in so many places.
CHIEF_SALTS = 16

_rng = np.random.default_rng(1997)
_MUL = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_WORD = _rng.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_ROW = _rng.integers(0, 1 << 64, ROWS, dtype=np.uint64) | np.uint64(1)

_words = Kept(xxhash.xxh3_64_intdigest)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than a shingle has are one shingle together."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total += hashes[i : n - size + 1 + i] * _WORD[i]
    return np.unique(mixed(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    small = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small), 1024):
        x = small[at : at + 1024, None] * _MUL + _ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64) * _ROW
    return mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def packed_bits(least: np.ndarray, bits: int = BITS) -> bytes:
    """The low bits of the minima, as a signature."""
    found = (least[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(found.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def signatures(blobs: list[bytes], bits: int = BITS) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u8").reshape(-1, PERMUTATIONS * bits // 64)


def estimates(one: np.ndarray, many: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity of a signature to others (broadcast), corrected for minima that agree in their low bits by chance."""
    differ = one ^ many
    for step in range(1, bits.bit_length()):
        differ |= differ >> np.uint64(1 << step - 1)
    lowest = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    unequal = np.bitwise_count(differ & lowest).sum(axis=-1, dtype=np.int64)
    chance = 0.5**bits
    return (1 - unequal / PERMUTATIONS - chance) / (1 - chance)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, signature, fine, keys = [], [], [], [], []
        for at in range(0, batch.num_rows, 128):
            for text in batch.column("text").slice(at, 128).to_pylist():
                found = shingles(text)
                n.append(len(found))
                if len(found):
                    least = minima(found)
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                    signature.append(packed_bits(least))
                    fine.append(packed_bits(least, FINE))
                    keys.append(band_keys(least).tobytes())
                else:
                    for column in (digest, signature, fine, keys):
                        column.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, signature, fine, keys))], names=["doc_id", "n_shingles", "digest", "signature", "fine", "keys"])


def _sets_of(name: str):
    """The sets of a column ``text``, for ids of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [shingles(x).tobytes() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(name), pa.array(found, pa.binary())], names=[name, "set"])

    return run


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or a little more, none empty."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if size:
        yield pa.concat_batches(waiting)


def _dealt(batches: Iterator[pa.RecordBatch], groups: int, frequent: int) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket: its keys of this batch, with the ids and signatures that have them."""
    for batch in gathered(batches, DEALT):
        ids = batch.column("rep").to_numpy()
        keys = unpack(b"".join(batch.column("keys").to_pylist()))
        who = np.repeat(np.arange(len(ids)), BANDS)
        order = np.lexsort((ids[who], keys))
        keys, who = keys[order], who[order]
        new = np.append(True, keys[1:] != keys[:-1])
        run = np.cumsum(new) - 1
        often = np.bincount(run)[run] >= frequent
        salt = np.uint64((1 + int(ids[0]) % SALTS) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        to = np.where(often, mixed(keys + salt), keys)
        lead = new & often  # the smallest goes to the common group as well
        keys, to, who = np.concatenate([keys, keys[lead]]), np.concatenate([to, keys[lead]]), np.concatenate([who, who[lead]])
        bucket = (to % np.uint64(groups)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(groups + 1))
        used = np.flatnonzero(np.diff(cuts)).tolist()
        bits = signatures(batch.column("signature").to_pylist())
        parts = [by[cuts[b] : cuts[b + 1]] for b in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), *(pa.array(x, pa.binary()) for x in ([pack(to[k]) for k in parts], [pack(ids[who[k]].view(np.uint64)) for k in parts], [bits[who[k]].tobytes() for k in parts]))],
            names=["bucket", "to", "ids", "bits"],
        )


def _led(rows: pa.Table, least: float, leaders: int, frequent: int) -> pa.Table:
    """First round: pairs of leaders and members of the groups of a bucket."""
    to, ids = joined(rows.column("to").to_pylist()), joined(rows.column("ids").to_pylist()).view(np.int64)
    bits = signatures(rows.column("bits").to_pylist())
    order = np.lexsort((ids, to))
    to, ids, bits = to[order], ids[order], bits[order]
    starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = np.append(starts[1:], len(to))
    pairs = []
    two = ends - starts == 2
    a, b = starts[two], starts[two] + 1
    near = estimates(bits[a], bits[b]) >= least
    pairs.append(np.stack([ids[a[near]], ids[b[near]], np.zeros(near.sum(), np.int64)], axis=1))
    more = ends - starts > 2
    for a, b in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
        left = np.arange(a, b)
        for _ in range(leaders):
            if len(left) < 2:
                break
            near = estimates(bits[left[0]], bits[left[1:]]) >= least
            led = ids[left[1:][near]]
            pairs.append(np.stack([np.full(len(led), ids[left[0]]), led, np.full(len(led), int(b - a > frequent))], axis=1))
            left = left[1:][~near]
    found = np.unique(np.concatenate(pairs), axis=0)
    found = found[found[:, 0] != found[:, 1]]
    return pa.table({"a": found[:, 0], "b": found[:, 1], "many": found[:, 2]})


def _across(rows: pa.Table, least: float, percent: int) -> pa.Table:
    """Second round: links between a block of queries and a block of members, of other components than the query's."""
    rows = rows.take(pa.array(np.argsort(rows.column("rep").to_numpy(), kind="stable")))
    ids, of = rows.column("rep").to_numpy(), rows.column("component").to_numpy()
    asks, answers, query = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "answers", "query"))
    bits = signatures(rows.column("fine").to_pylist(), FINE)
    keys = unpack(b"".join(rows.column("keys").to_pylist())).reshape(-1, BANDS)
    sets = rows.column("set")
    links = []
    answer = np.flatnonzero(answers)
    for q in np.flatnonzero(asks).tolist():
        guess = estimates(bits[q], bits[answer], FINE)
        near = (guess >= least) & (of[answer] != of[q])
        near &= ~query[answer] | (ids[answer] > ids[q])  # a pair of queries once
        near[near] &= (keys[answer[near]] == keys[q]).any(axis=1)
        found = answer[near][np.argsort(-guess[near], kind="stable")]
        if not len(found):
            continue
        one = unpack(sets[q].as_py())
        while len(found):
            part, found = found[:32], found[32:]
            linked = [i for i in part.tolist() if similar(one, unpack(sets[i].as_py()), percent)]
            links += [(min(ids[q], ids[i]), max(ids[q], ids[i])) for i in linked]
            found = found[~np.isin(of[found], of[linked])]
    return pa.table({"a": pa.array([int(x[0]) for x in links], pa.int64()), "b": pa.array([int(x[1]) for x in links], pa.int64())})


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Of sorted distinct hashes. Sizes may rule it out."""
    if 100 * min(len(one), len(other)) < percent * max(len(one), len(other)):
        return False
    small, large = (one, other) if len(one) < len(other) else (other, one)
    both = int(_among(small, large).sum())
    return 100 * both >= percent * (len(one) + len(other) - both)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by (a, salt, part): a's own row comes first and has its set, the others those of its partners."""
    key, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        linked, sets = [], batch.column("set")
        for i, (*of, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "part", "b")), strict=True)):
            if of[0] == b:
                key, own = of, unpack(sets[i].as_py())
            elif of == key and similar(own, unpack(sets[i].as_py()), percent):
                linked.append((of[0], b))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b, many) whose full sets are similar enough. ``many`` marks the partners of leaders of large groups: they are salted."""
    pairs = checkpointed(pairs.groupBy("a", "b").agg(F.max("many").alias("many")), True)
    wanted = pairs.select("b").union(pairs.select("a")).distinct().withColumnRenamed("b", "doc_id")
    sets = texts.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("b"), "text").mapInArrow(frugal(_sets_of("b")), "b long, set binary")
    salted = pairs.select("a", "b", F.when(F.col("many") > 0, 1 + F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0).alias("salt"))
    count = salted.groupBy("a", "salt").agg((F.floor(F.count(F.lit(1)) / PARTNERS) + 1).cast("long").alias("parts"))
    dealt = salted.join(count, ["a", "salt"]).select("a", "salt", F.pmod(F.xxhash64("b", F.lit(1)), F.col("parts")).alias("part"), "b")
    selves = count.select("a", "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"))
    rows = dealt.union(selves).join(sets, "b").select("a", "salt", "part", "b", "set")
    ordered = rows.repartition("a", "salt", "part").sortWithinPartitions("a", "salt", "part", F.col("a") != F.col("b"))
    return checkpointed(ordered.mapInArrow(frugal(lambda it: _confirmed(it, percent)), "a long, b long"), True)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, groups: int | None = None, leaders: int = LEADERS, frequent: int = FREQUENT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A-Z is lower-cased; words are parted by ASCII white space. Texts without words (null, empty or blank)
    have no set and are linked with nothing. component_id is the smallest id reachable over links; the row
    that has it is kept. Ids are integers; rows that share an id are one document, and all of them are kept or
    none. A null id links nothing: alone in its class of equal sets such a row is kept with a null
    component, else it goes. A very long text is one row with its whole set, of 8 bytes for each distinct shingle.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    sketches = checkpointed(texts.mapInArrow(frugal(_sketches), "doc_id long, n_shingles long, digest binary, signature binary, fine binary, keys binary"))
    classes = sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"), F.min("fine").alias("fine"), F.min("keys").alias("keys"), F.min("n_shingles").alias("n"))
    classes = checkpointed(classes)
    reps = classes.where("rep is not null").select("rep", "signature", "fine", "keys", "n")
    least, least_fine = (percent / 100 - MARGIN[b] for b in (BITS, FINE))
    if groups is None:
        groups = max(partitions(spark), -(-reps.count() // 20_000))
    dealt = reps.drop("fine", "n").mapInArrow(lambda it: _dealt(it, groups, frequent), "bucket long, to binary, ids binary, bits binary")
    pairs = dealt.groupBy("bucket").applyInArrow(frugal_group(lambda t: _led(t, least, leaders, frequent)), "a long, b long, many long")
    links = confirm(pairs, texts, percent)
    found = components(links)

    placed = reps.join(found, F.col("rep") == F.col("node"), "left").select("rep", "keys", F.coalesce("component", "rep").alias("component"))
    split = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("keys"), i * 8 + 1, F.lit(8)))
    keyed = placed.select("rep", "component", F.explode(split).alias("key"))
    opened = keyed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    members = keyed.join(opened, "key")
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    chiefs = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("chief"))
    gathered = checkpointed(members.join(chiefs, "key").select("chief", "rep", "component").distinct(), True)
    gathered = gathered.withColumns({"query": F.col("component") != F.col("chief"), "salt": F.pmod(F.xxhash64("rep"), F.lit(CHIEF_SALTS))}).join(reps.drop("signature"), "rep")
    sets = texts.join(gathered.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text").mapInArrow(frugal(_sets_of("rep")), "rep long, set binary")
    share = lambda c: F.coalesce(F.sum(F.when(c, F.greatest(F.lit(1 / block), F.col("n") * (8 / block_bytes)))), F.lit(0.0))
    blocks = gathered.groupBy("chief").agg((F.floor(share(F.lit(True))) + 1).cast("int").alias("blocks"), (F.floor(share(F.col("query"))) + 1).cast("int").alias("query_blocks"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHIEF_SALTS - 1).cast("long"))))
    full = gathered.join(blocks, ["chief", "salt"]).join(sets, "rep")
    home = lambda c, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # A query asks and answers in one row where its blocks meet; it answers the other blocks of queries and asks the other blocks of members.
    homes = full.select("chief", "rep", "component", "fine", "keys", "set", "query", home("blocks", 0).alias("b"), home("query_blocks", 1).alias("q"), "blocks", "query_blocks")
    place = lambda b, q, answers, asks: F.struct(b.alias("block"), q.alias("query_block"), answers.alias("answers"), asks.alias("asks"))
    answered = F.transform(every("query_blocks"), lambda q: place(F.col("b"), q, F.lit(True), F.col("query") & (q == F.col("q"))))
    asked = F.transform(F.filter(every("blocks"), lambda b: F.col("query") & (b != F.col("b"))), lambda b: place(b, F.col("q"), F.lit(False), F.lit(True)))
    dealt = homes.select("chief", "rep", "component", "fine", "keys", "set", "query", F.explode(F.concat(answered, asked)).alias("place")).select("*", "place.*").drop("place")
    again = dealt.groupBy("chief", "block", "query_block").applyInArrow(frugal_group(lambda t: _across(t, least_fine, percent)), "a long, b long")
    again = checkpointed(again, True)
    if not again.isEmpty():
        found = components(links.union(again))
    classes = classes.select("digest", "rep")
    ids = sketches.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(found, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return ids.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
