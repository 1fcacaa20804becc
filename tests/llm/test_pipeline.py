import random
import re
import zlib

import public_tokenizers

import corpus_pipeline
from quillfold.llm import quality_classifier
from quillfold.llm.packing import DocumentIds


def test_pipeline_against_brute_force(spark, tmp_path):
    """The stages one after another in plain Python, with the same model, over a small table."""
    words = [f"tok{i}" for i in range(400)]
    text = lambda s, n=80: " ".join(random.Random(s).choices(words, k=n))
    rows, labels = [], []
    for i in range(120):
        good = i % 4 > 0
        rows.append((i, text(i) if good else " ".join(w.upper() + "!!" for w in text(i).split()), "en", "s", 0))
        labels.append((i, int(good)))
    passage = "a passage that several of the documents share word for word and that is long enough to be seen as a repeat by all"
    rows += [(200, text(1) + "\n", "en", "s", 0), (201, text(2) + " another", "en", "s", 0), (202, text(500) + " " + passage, "en", "s", 0), (203, text(600) + " " + passage + " é", "en", "s", 0), (204, text(1).replace(" ", "\t"), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")

    model = quality_classifier.fit(docs, marks)
    score = quality_classifier.scores(model, quality_classifier.pooled([r[1] for r in rows], model.vectors, quality_classifier._rows(model.words)))
    left = [(r[0], r[1]) for r, s in zip(rows, score, strict=True) if s >= quality_classifier.THRESHOLD]
    assert 60 < len(left) < len(rows)
    seen, once = set(), []
    for i, t in sorted(left):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if key not in seen:
            seen.add(key)
            once.append((i, t))
    sets = {i: set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for i, t in once}
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if x in (a, b) else x for k, x in up.items()}
    near = [(i, t) for i, t in once if up[i] == i]
    assert len(near) < len(once)
    windows, cut = set(), []
    for i, t in near:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in windows:
                gone[p : p + 100] = b"\1" * 100
            windows.add(raw[p : p + 100])
        kept, at = "", 0
        for c in t:
            n = len(c.encode())
            kept += "" if all(gone[at : at + n]) else c
            at += n
        if kept or not raw:
            cut.append((i, kept))
    assert sum(len(t) for _, t in cut) < sum(len(t) for _, t in near)
    ids = DocumentIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted((i, len(raw) // 4, zlib.crc32(raw)) for i, t in cut for raw in [ids(t) + (2).to_bytes(4, "little")])

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.length, x.ids_crc32) for x in found) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_dedup", "suffix_dedup", "best_fit_packing"]


def test_stages_keep_rows_and_columns(spark):
    words = [f"tok{i}" for i in range(400)]
    text = lambda s: " ".join(random.Random(s).choices(words, k=60))
    rows = [(1, text(1)), (2, text(1) + " "), (2, None), (3, text(2)), (4, text(2) + " more"), (None, text(2) + " more"), (None, text(3)), (5, "")]
    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, kept string, n_chars long, row string")
    left = lambda stage, d: sorted(((x.doc_id, x.text) for x in stage(spark, d, "").collect()), key=str)
    exact = corpus_pipeline.exact_stage(spark, docs, "")
    assert exact.columns == docs.columns and left(lambda s, d, _: d, exact) == sorted([(1, text(1)), (2, text(1) + " "), (2, None), (3, text(2)), (4, text(2) + " more"), (None, text(3))], key=str)
    near = left(corpus_pipeline.near_stage, docs)
    assert near == sorted([(1, text(1)), (3, text(2)), (None, text(2) + " more"), (None, text(3)), (5, "")], key=str)
    cut = corpus_pipeline.suffix_stage(spark, docs, "")
    assert cut.columns == docs.columns and {(x.doc_id, x.text, x.n_chars, x.kept, x.row) for x in cut.where("doc_id in (1, 3, 5)").collect()} == {(1, text(1), len(text(1)), "a", "b"), (3, text(2), len(text(2)), "a", "b"), (5, "", 0, "a", "b")}
    assert corpus_pipeline.packing_stage(spark, docs.where("doc_id < 0"), "").count() == 0
