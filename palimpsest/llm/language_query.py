"""Registered query of language ID (learnt, so there is no SQL form; held-out accuracy is tested)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import language
from palimpsest.llm.work import table


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.train(*language.sample(docs))
    found = language.predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL = {}
