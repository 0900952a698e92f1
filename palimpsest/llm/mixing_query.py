"""Registered query of source mixing, in tokens of the byte-level vocabulary (seeded by a hash that SQL lacks; tested against a brute-force version)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, separators
from palimpsest.llm.separators_query import RANKS
from palimpsest.llm.work import table

DOMAINS = ("web", "books", "forum")
TARGET = mixing.Target(
    weights={("web",): 5, ("books",): 3, ("forum",): 2}
    | {(d, lang): w for d in DOMAINS for lang, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))},
    share=0.6,
    epochs=3,
)


def levels() -> list[Column]:
    """Domain (by the number in the source's name), language, source."""
    number = F.try_to_number(F.regexp_extract(F.col("source"), r"(\d+)$", 1), F.lit("99999")).cast("int")
    domain = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.coalesce(F.pmod(number, F.lit(len(DOMAINS))), F.lit(0)) + 1)
    return [domain, F.col("lang"), F.col("source")]


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = separators.with_counts(table(spark, sf_dir, "documents"), RANKS)
    return mixing.selection(docs, TARGET, levels(), tokens=F.col("n_tokens"))


QUERIES = {"op10_source_mixing": op10_source_mixing}
ORACLE_SQL = {}
