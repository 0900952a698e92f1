"""Registered query of SentencePiece encoding (no SQL form; tested by round trip and against the library)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import pieces
from palimpsest.llm.work import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, check=True).select("doc_id", "n_tokens", "ids", "round_trip")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLE_SQL = {}
