"""Session settings that the folds rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Re-associating checked arithmetic hides overflow, which here is an error with a name.
EXCLUDED_RULE = "org.apache.spark.sql.catalyst.optimizer.ReorderAssociativeOperator"


def configure(spark: SparkSession) -> SparkSession:
    """UTC, ANSI arithmetic, program order of checked arithmetic, and this package on the workers' path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    rules = [r for r in (spark.conf.get("spark.sql.optimizer.excludedRules", "") or "").split(",") if r]
    if EXCLUDED_RULE not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, EXCLUDED_RULE]))
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
