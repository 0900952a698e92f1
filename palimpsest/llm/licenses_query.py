"""Registered query of the license scan (no SQL form; tested against planted notices and a longest common subsequence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import licenses
from palimpsest.llm.work import table


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL = {}
