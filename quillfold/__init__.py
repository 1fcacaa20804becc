"""Folds, checks and pipelines over append-only ledgers, as Spark DataFrames."""
