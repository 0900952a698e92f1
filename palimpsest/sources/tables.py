"""Tables in user files: Parquet, or CSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _kind(path: str) -> str:
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end == "parquet":
        return "parquet"
    if end in ("csv", "txt"):
        return "csv"
    raise ValueError(f"{path}: the name must end in .parquet, .csv or .txt")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if _kind(path) == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True)


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """Write a folder of files; with single, of one file."""
    out = (df.coalesce(1) if single else df).write
    if _kind(path) == "parquet":
        out.parquet(path)
    else:
        out.csv(path, header=True)
