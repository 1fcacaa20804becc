import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfold.llm.components import components
from quillfold.llm.deep_shallow import deep_shallow
from quillfold.llm.exact_dedup import exact_dedup
from quillfold.llm.near_dedup import estimates, near_dedup, packed_bits, signatures
from quillfold.llm.suffix_dedup import suffix_dedup

DOCS = "doc_id long, text string, kept string, n long, digest string"


def frame(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(3)


# -- exact


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        same = [j for (j, _), u in zip(rows, norm, strict=True) if u == t]
        ids = [j for j in same if j is not None]
        out.append((i, min(ids) if ids else None, len(same)))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.md5(c), 1, 1)], ids=["sha256", "colliding"])
def test_exact(spark, digest):
    r = random.Random(1)
    pool = ["", None, " ", "a b", "a  b", "a\tb", "a\x0b\x0cb", "a b", "x" * 5000, "é\n", "é "] + [f"t{i}" for i in range(20)]
    rows = [(i if i % 9 else None, r.choice(pool)) for i in range(150)] + [(3, "twice"), (3, "twice"), (None, "lonely")]
    found = exact_dedup(frame(spark, rows), **({"digest": digest} if digest else {})).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size) for x in found), key=str) == brute_exact(rows)
    assert all(x.kept == (x.doc_id == x.keep_id) for x in found)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    assert exact_dedup(none).count() == near_dedup(none).count() == suffix_dedup(none).count() == 0


# -- suffix arrays


def brute_suffix(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        n, gone = len(t), bytearray(len(t))
        for p in range(n - 99):
            w, k = t[p : p + 100], (1 << 63 if i is None else i, p)
            if w in seen:
                if seen[w] < k:
                    gone[p : p + 100] = b"\1" * 100
            else:
                seen[w] = k
        spans = [(p, next((q for q in range(p, n) if not gone[q]), n)) for p in range(n) if gone[p] and (p == 0 or not gone[p - 1])]
        out.append((i, n, spans, bytes(t[p] for p in range(n) if not gone[p])))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_is_brute_force(spark, seed):
    r = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefgh \0é"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(400))) for _ in range(10)]
    rows = []
    for i in range(100):
        k, text = r.random(), r.choice(base)
        if k < 0.35:
            text = "".join((b := r.choice(base))[(a := r.randrange(100)) : a + r.randrange(260)] for _ in range(r.randrange(1, 5)))
        elif k < 0.6 and text:
            at = r.randrange(len(text))
            text = text[:at] + r.choice(letters) + text[at + 1 :]
        elif k < 0.7:
            text = "a" * r.randrange(500)
        rows.append((i if i % 30 else None, text))
    rows += [rows[5], (7, "z" * 150), (8, None), (9, "")]
    found = suffix_dedup(frame(spark, rows), batch_bytes=4000, bucket_bytes=4000).collect()
    got = sorted(((x.row.doc_id, x.n_bytes, [(s.start, s.stop) for s in x.spans], bytes(x.kept)) for x in found), key=str)
    assert got == brute_suffix([(i, (t or "").encode()) for i, t in rows])


def test_short_and_blank_texts_keep_all(spark):
    rows = [(1, "short"), (2, "short"), (3, ""), (4, None)]
    found = suffix_dedup(frame(spark, rows)).collect()
    assert sorted((x.row.doc_id, bytes(x.kept), len(x.spans)) for x in found) == [(1, b"short", 0), (2, b"short", 0), (3, b"", 0), (4, b"", 0)]
    assert suffix_dedup(frame(spark, rows[2:])).count() == 2


def test_whole_characters_stay_text(spark):
    passage = "".join(chr(0x100 + (7 * i + i * i) % 301) for i in range(120))
    rows = [(1, "x" + passage), (2, passage + "tail"), (3, "yy" + passage)]
    found = suffix_dedup(frame(spark, rows), keep=["doc_id", "n"], characters=True).collect()
    texts = {x.row.doc_id: bytes(x.kept).decode() for x in found}
    assert texts == {1: "x" + passage, 2: "tail", 3: "yy"}


def test_deep_shallow_sorts():
    r = np.random.default_rng(1)
    for t in range(60):
        n, w = int(r.integers(1, 50)), int(r.choice([8, 20, 50]))
        rows = r.integers(0, 1 + t % 3, (n, w)).astype(np.uint8)
        for i in range(n):
            rows[i, : r.integers(0, w + 1)] = rows[r.integers(0, n), 0]
        groups = r.integers(0, 3, n)
        order, common = deep_shallow(rows, groups, 8 if t % 2 else 16)
        key = lambda i: (groups[i], rows[i].tobytes())  # noqa: E731, B023
        assert [key(i) for i in order] == sorted(map(key, range(n)))
        for x in range(1, n):
            a, b = rows[order[x - 1]], rows[order[x]]
            assert common[x] == (-1 if groups[order[x - 1]] != groups[order[x]] else next((q for q in range(w) if a[q] != b[q]), w))


# -- near copies


def brute_near(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("how", [{}, {"leaders": 1, "frequent": 2, "block": 3}], ids=["production", "all in the second round"])
def test_near_dedup_is_brute_force(spark, how):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = ["", " \n", None, "one", "one", "two words", "ONE"]
    for _ in range(10):
        base = [r.choice(vocabulary) for _ in range(r.randrange(3, 120))]
        for _ in range(r.randrange(1, 20)):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.2:
                base = words
            texts.append("  ".join(words))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    found = near_dedup(frame(spark, rows), **how).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == brute_near(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "alone here")]
    found = sorted(((x.doc_id, x.component_id, x.kept) for x in near_dedup(frame(spark, rows)).collect()), key=str)
    assert found == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True)], key=str)


def test_estimates_are_corrected():
    r = np.random.default_rng(0)
    one = r.integers(0, 1 << 32, 128, dtype=np.uint64).astype(np.uint32)
    for share in (0.0, 0.5, 1.0):
        guess = []
        for _ in range(200):
            other = np.where(r.random(128) < share, one, r.integers(0, 1 << 32, 128, dtype=np.uint64).astype(np.uint32))
            guess.append(float(estimates(signatures([packed_bits(one)])[0], signatures([packed_bits(other)]))[0]))
        assert abs(np.mean(guess) - share) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 300)]
    found = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | {200: 200, 300: 200}
