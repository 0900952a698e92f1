"""A training corpus from raw documents: rules, language, near-duplicates, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, of
the documents they keep. `run` writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import language, mixing, pieces, quality, separators, simhash
from palimpsest.llm.mixing_query import TARGET, levels
from palimpsest.llm.pieces_query import MODEL
from palimpsest.llm.separators_query import RANKS
from palimpsest.llm.work import stage, table

#: How sure the network must be that a text is noise: random or shuffled letters, or a script that it has not
#: learnt. A language not learnt in letters that were may pass as the nearest one.
SURE = 0.9
#: What near-duplicates share: words of a shingle, and Jaccard similarity of the sets of shingles.
SHINGLE, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table.

    Null, empty and blank texts have no words and go. Each row is judged alone, whatever its length, its id (null too) or its
    copies; extra columns stay, also where they are called like a count; an empty table stays empty.
    """
    return quality.apply_rules(docs).filter("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language: what has no letter goes, and what the network takes for noise with a score of SURE.

    Null and empty texts go. Without labelled rows nothing can be learnt, and what has a letter stays. Repeated rows and
    ties are predicted alike; extra columns stay but for lang_pred and score, which are replaced; an empty table stays empty.
    """
    pieces_, labels = language.sample(docs)
    if not labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, language.train(pieces_, labels, reject=True))
    noise = (F.col("lang_pred") == language.UNKNOWN) | ((F.col("lang_pred") == language.REJECT) & (F.col("score") >= SURE))
    return found.filter(~noise).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates: shingles of SHINGLE words, SIMILARITY or more.

    Texts without words are one group. Of repeated rows of one doc_id one stays; rows without doc_id all stay, as no group can
    be named by them. Extra columns stay; an empty table stays empty.
    """
    return simhash.keep_first(docs, shingle=SHINGLE, similarity=SIMILARITY).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights in tokens, once for each epoch that selects them.

    Null labels are a leaf of their own; a text without tokens costs nothing. Rows equal in doc_id and text are taken or left
    together. Extra columns stay; an empty table stays empty.
    """
    counted = separators.with_counts(docs.select("doc_id", "lang", "source", "text"), RANKS)
    return mixing.mix(docs, TARGET, levels(), made=mixing.plan(counted, TARGET, levels(), tokens=F.col("n_tokens")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number and whether they decode to the text: null for a null text, no ids for an empty one."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), MODEL, check=True).select(
        "doc_id", "lang", "source", "n_tokens", "ids", "round_trip"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("token_ids", token_ids),
]

#: Learnt models and seeded hashes have no SQL form; the whole run is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
