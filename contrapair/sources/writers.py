"""Sinks. Spark's committer makes each write appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_measurements(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_measurements(df: DataFrame, path: str) -> None:
    write_measurements(df, path, mode="append")


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
