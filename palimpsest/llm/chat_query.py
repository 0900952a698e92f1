"""Registered query of chat formatting (a learnt model has no SQL form; held-out accuracy and brute force are tested).

The conversations table is first written as raw transcripts: every conversation names its speakers in one of several
styles, and some turns lack a marker. The operator sees the transcript alone; the true role is joined to its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat
from palimpsest.llm.work import table

#: (system, user, assistant) markers of each style.
STYLES = (("System: ", "User: ", "Assistant: "), ("[context] ", "[human] ", "[AI] "), ("### System:\n", "### Instruction:\n", "### Response:\n"), ("Setup: ", "Q: ", "A: "))
UNMARKED = 6  # one turn in so many lacks its marker


def transcripts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a speaker marker written before most texts."""
    style = F.pmod(F.xxhash64(F.lit(1), "conv_id"), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(chat.ROLES, names, strict=True):
            mark = F.when((style == k) & (F.col("role") == role), F.lit(name)).otherwise(mark)
    bare = F.pmod(F.xxhash64(F.lit(2), "conv_id", "turn"), F.lit(UNMARKED)) == 0
    return rows.select("conv_id", "turn", "role", F.concat(F.when(bare, "").otherwise(mark), "text").alias("text"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = transcripts(table(spark, sf_dir, "conversations"))
    return chat.parse(raw, chat.fit(chat.sample(raw))).select("conv_id", "turn", "copies", "role_pred", "rendered")


QUERIES = {"op5_chat_formatting": op5_chat_formatting}
ORACLE_SQL = {}
