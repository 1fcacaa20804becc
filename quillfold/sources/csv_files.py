"""Delimited text with a declared schema: every column is text at first; conversions refuse by name, not by guess."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows with a header, quotes doubled inside quotes, one line for each row. A header that isn't ``columns`` raises.

    ``order`` adds the arrival order inside a file, as a struct of file and a growing number, for first and last.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"').option("multiLine", False).option("mode", "FAILFAST").csv(path)
    rows = rows.select([F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns] + ([F.col("_metadata.file_path").alias("_file")] if order else []))
    if order:
        rows = rows.select(*columns, F.struct("_file", F.monotonically_increasing_id().alias("_n")).alias(order))
    return rows


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
