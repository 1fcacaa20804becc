"""Edges that every operator has a defined result for: empty tables, clashing names, nulls in every column, repeated rows, long texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillfold.llm import entries, lm_scoring, near_dedup, quality_classifier
from quillfold.llm.byte_bpe import byte_bpe_digests
from quillfold.llm.exact_dedup import exact_dedup
from quillfold.llm.near_dedup import gathered, similar
from quillfold.llm.packing import best_fit_packing
from quillfold.llm.quality_rules import quality_rules
from quillfold.llm.suffix_dedup import suffix_dedup
from quillfold.llm.token_counts import token_counts
from quillfold.llm.url_filter import Rule, filter_urls

MULTI, JSON, RANKS = (public_tokenizers.path(f"byte_bpe_{x}") for x in ("multi_50k.tiktoken", "50k.json", "50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
RULES = (Rule("block", "x.org", "/"),)
#: Names that operators use inside.
NAMES = ("row", "batch", "bucket", "norm", "digest", "winner", "n", "salt", "a", "b", "key", "keys", "rep", "component", "host", "score", "label", "kept", "part", "piece", "short", "found", "rank", "start", "cell", "pos", "_key", "_hot")

OPERATORS = {
    "exact": lambda d: exact_dedup(d),
    "urls": lambda d: filter_urls(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.col("text")), RULES),
    "suffix": lambda d: suffix_dedup(d),
    "rules": lambda d: quality_rules(d),
    "classifier": lambda d: quality_classifier.quality_scores(d, quality_classifier.fit(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "near": lambda d: near_dedup.near_dedup(d),
    "bpe": lambda d: byte_bpe_digests(d, MULTI, PATTERN),
    "packing": lambda d: best_fit_packing(d, JSON, RANKS, PATTERN),
    "counts": lambda d: token_counts(d, MULTI, PATTERN),
    "lm": lambda d: lm_scoring.lm_scores(d),
}


def table(spark, rows, clash=False):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return d.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)]) if clash else d


ROWS = [(1, "some words of a text", "s", "en", 1), (2, None, None, None, None), (None, "no id here", "s", None, 3), (None, None, None, None, None), (3, "", "t", "en", 0), (3, "", "t", "en", 0), (4, " \n\t", "t", "en", 3), (5, "some words of a text", "t", "en", 1)]


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](table(spark, ROWS).where("doc_id > 100")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, name):
    """Nulls in every column, repeated rows and blank texts give a row each; columns with names of the operators' own are ignored."""
    plain, clashing = (OPERATORS[name](table(spark, ROWS, clash).coalesce(1)) for clash in (False, True))
    got, same = (sorted(map(str, x.drop("sequence_id", "offset").collect())) for x in (plain, clashing))
    assert got == same and len(got) == len(ROWS) and plain.columns == clashing.columns


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"urls"}))
def test_a_very_long_text_is_one_row(spark, name):
    """Two texts of a million words that differ at their ends only, between short ones."""
    long = " ".join(f"w{i % 50_021}" for i in range(1_000_000))
    rows = [(1, "short", "s", "en", 1), (2, long, "s", "en", 1), (3, long + " end", "s", "en", 1)]
    found = OPERATORS[name](table(spark, rows)).collect()
    if name == "packing":
        assert {x.doc_id for x in found} == {1, 2, 3} and len(found) > 2000
        return
    by = {(x.row.doc_id if name == "suffix" else x.doc_id): x for x in found}
    assert set(by) == {1, 2, 3} and len(found) == 3
    if name == "exact":
        assert all(x.kept for x in found)
    if name == "near":
        assert by[3].component_id == 2 and by[2].n_shingles == 50_021 and by[1].component_id == 1
    if name == "suffix":
        assert by[3].n_bytes == len(long) + 4 and len(by[3].kept) < 200
    if name in ("rules", "lm"):
        assert (by[2].n_words if name == "rules" else by[2].n_tokens - 1) == 1_000_000


def test_a_url_of_many_labels_and_a_long_path(spark):
    rows = [(1, "http://" + "a." * 300 + "x.org/" + "p/" * 50_000), (2, "http://" + "y" * 100_000 + "/"), (3, "://")]
    found = {x.page_id: x for x in filter_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert found[1].verdict == "block" and found[1].rule == "x.org/" and found[2].verdict == "allow" and found[3].host == ""


def test_hot_groups_and_ties(spark):
    """A third of all rows are one text, the ids of another tie; groups beyond the broadcast ones are joined."""
    rows = [(i, "the same" if i % 3 == 0 else f"text {i % 500}", "s", "en", 1) for i in range(3000)]
    found = {x.doc_id: x for x in exact_dedup(table(spark, rows).repartition(8)).collect()}
    want = {}
    for i, t, *_ in rows:
        want.setdefault(t, []).append(i)
    assert all(found[i].keep_id == min(want[t]) and found[i].group_size == len(want[t]) for i, t, *_ in rows)


def test_exact_dedup_carries_columns(spark):
    d = table(spark, ROWS, True)
    found = exact_dedup(d, keep=d.columns)
    assert found.where("kept").select("row.*").columns == d.columns and sorted(map(str, found.select("row.*").collect())) == sorted(map(str, d.collect()))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    table(spark, ROWS).where("doc_id > 100").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_set_similarity_and_batches():
    import numpy as np
    import pyarrow as pa

    a = np.arange(100, dtype=np.uint64)
    assert similar(a, np.arange(75, dtype=np.uint64), 75) and not similar(a, np.arange(74, dtype=np.uint64), 75) and similar(a[:75], a, 75)
    assert not similar(a, a + np.uint64(15), 75) and similar(a, a + np.uint64(14), 75)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], names=["x"]) for n in (0, 3, 5, 0, 1)]
    assert [b.num_rows for b in gathered(iter(batches), 4)] == [8, 1]


def test_unlike_documents_that_share_keys_are_not_paired(spark):
    """Documents of a common part and words of their own: none is linked, and what is dealt in the second round grows with their number."""
    import random

    r = random.Random(1)
    common = " ".join(f"c{i}" for i in range(160))
    rows = [(i, common + " " + " ".join(f"w{r.randrange(10**7)}" for _ in range(100)), "s", "en", 1) for i in range(600)]
    found = near_dedup.near_dedup(table(spark, rows).repartition(4), block=100).collect()
    assert all(x.kept for x in found) and len(found) == 600


def test_queries_are_registered():
    assert sorted(entries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(entries.QUERIES) and len(entries.QUERIES) == 10
    assert set(entries.ORACLE_SQL) == {"op1_exact_dedup", "op2_url_filter", "op4_quality_rules"}
