"""Quality rules for documents, and host-level rules with shrunken failure rates.

A document fails by its own words. A host (the ``source`` column) fails by its documents: failures are summed
by host, the rates of all hosts give a beta prior by the method of moments, and each host's rate is shrunk
towards it, so hosts with few documents follow the corpus and hosts with many follow themselves. A host is rejected
if its shrunken rate is above the prior's mean by more than ``HOST_DEVIATIONS`` of the prior's own standard
deviations, or above ``HOST_THRESHOLD`` in any case: it stands out among the hosts, or most of it fails. Verdicts on
hosts are joined back to their documents, and a rejected host takes its good documents along.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import SPACE, checkpointed, frugal, prepare, text_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected if its shrunken failure rate is above this, or so many standard deviations above the mean of the prior.
HOST_THRESHOLD, HOST_DEVIATIONS = 0.5, 1.0
#: Least and most weight of the prior, in documents.
PRIOR_WEIGHT = (2.0, 1e6)


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    covered = upto = 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def measures(text: bytes) -> Measures:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return Measures(len(words), len(text.translate(None, SPACE).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(x) for at in range(0, batch.num_rows, 128) for x in batch.column("text").slice(at, 128).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(Measures._fields)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], names=["doc_id", "host", *Measures._fields])


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the five measures of every whole text; null text has no words."""
    prepare(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(frugal(_measured), f"doc_id {kind}, host string, " + ", ".join(f"{x} long" for x in Measures._fields))


def beta_prior(mean: float, variance: float) -> tuple[float, float]:
    """Beta parameters of the given mean and variance; the weight stays within PRIOR_WEIGHT."""
    least, most = PRIOR_WEIGHT
    weight = most if variance <= 0 else min(most, max(least, mean * (1 - mean) / variance - 1))
    return mean * weight, (1 - mean) * weight


def host_limit(a: float, b: float, threshold: float = HOST_THRESHOLD, deviations: float = HOST_DEVIATIONS) -> float:
    """The highest rate of a host that is kept, for the beta prior's parameters."""
    mean = a / (a + b)
    return min(threshold, mean + deviations * math.sqrt(mean * (1 - mean) / (a + b + 1)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = HOST_THRESHOLD, deviations: float = HOST_DEVIATIONS) -> DataFrame:
    """doc_id, the five measures, base_failed, kept, host and host_rate for every row of ``docs``.

    Null text is empty and fails. A null host is a host of its own. Repeated rows are judged and counted as
    often as given. A host whose rate is exactly at its limit is kept. A very long text is measured whole, by one
    task. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = checkpointed(document_measures(docs, id_col, text_col, host_col).withColumn("base_failed", failed))
    hosts = checkpointed(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")), True)
    total = hosts.agg(F.sum("n"), F.sum("f"), F.sum(F.col("f") * F.col("f") / F.col("n"))).first()
    n, f, squares = (float(x or 0) for x in total)
    mean = f / n if n else 0.0
    a, b = beta_prior(mean, squares / n - mean * mean if n else 0.0)
    limit = host_limit(a, b, threshold, deviations)
    rates = hosts.select(F.col("host").alias("of_host"), ((F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias("host_rate"))
    found = rows.join(rates, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return found.select("doc_id", *Measures._fields, "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= limit)).alias("kept"), "host", "host_rate")
