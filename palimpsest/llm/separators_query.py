"""Registered query of the token counts (a BPE vocabulary has no SQL form; tested against direct encoding)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import separators
from palimpsest.llm.work import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256


def op1_token_counts(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    files, documents = separators.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, END_ID)
    counted = separators.scan(files, END_ID)
    return documents.join(counted, ["path", "nth"]).select("doc_id", "n_tokens", "start")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL = {}
