"""A corpus pipeline of five stages over ``documents``: each reads what its predecessor wrote.

Null texts are empty: without a token they have a low score, and the classifier rejects them if its labels say so. All
columns of the input are kept up to the last stage, whatever their names; an empty table passes all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm._runtime import shared_folder
from quillfold.llm.exact_dedup import exact_dedup
from quillfold.llm.near_dedup import near_dedup
from quillfold.llm.packing import best_fit_packing
from quillfold.llm.quality_classifier import THRESHOLD, fit, with_scores
from quillfold.llm.suffix_dedup import suffix_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model, docs.columns).where(F.col("score") >= THRESHOLD).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup(docs, keep=docs.columns).where("kept").select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the smallest id stays. Rows without an id can't be told apart, and all stay."""
    gone = near_dedup(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so do documents of which nothing else is left. n_chars is that of the new text."""
    cut = suffix_dedup(docs, keep=[c for c in docs.columns if c != "text"], characters=True)
    left = cut.where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    text = F.col("kept").cast("string")
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_dedup", near_stage),
    ("suffix_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

#: Stages use a trained model, suffix arrays and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def _dropped(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again. What the next stage has read and written goes; what the last one reads stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            here = f"{folder}/{number}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if before is not None:
                _dropped(spark, before)
            before = here
    return docs
