"""Registered query of the nearest neighbours (approximate: recall is tested against brute force)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import neighbours
from palimpsest.llm.work import table

NEAREST = 5
EVERY = 50


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, NEAREST)


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
ORACLE_SQL = {}
