"""Registered query of HTML extraction (learnt; tested on pages of known text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import extract
from palimpsest.llm.work import table


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLE_SQL = {}
