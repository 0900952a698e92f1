"""Every operator beside columns whose names clash with its own working columns, its outputs, or differ from its inputs by case only."""

import corpus_pipeline
import pytest
from palimpsest.llm import chat, extract, language, licenses, mixing, neighbours, pieces, quality, separators, simhash
from palimpsest.llm.pieces_query import MODEL
from palimpsest.llm.separators_query import END_ID, RANKS
from pyspark.sql import functions as F

TEXT = "The rain fell on the hills and the river rose by the mill until noon. " * 4
CLASH = "1 cut, 2 whole, 'mine' __text, 4 N_WORDS, 5 IDS, 6 `__domain`, 7 epoch, 8 place, 9 tokens, 10 h1, 11 cell, 12 sub, 13 at, 14 lang_PRED, 15 Score, 16 fp, 17 sig, 18 k1, 19 n, 20 `rows`, 21 `a b`, 22 __words, 23 Kept, 24 many, 25 vec"


def docs(spark, text="text"):
    rows = [(1, TEXT, "en", "s1"), (2, TEXT, "en", "s1"), (3, None, None, None), (4, "", "de", "s2"), (5, "x " * 30, "en", "s1")]
    return spark.createDataFrame(rows, f"doc_id long, {text} string, lang string, source string").selectExpr("*", *CLASH.split(", "))


OPERATORS = {
    "op1": lambda d: separators.scan(separators.write_token_files(d, RANKS, END_ID)[0], END_ID),
    "op1 counts": lambda d: separators.with_counts(d, RANKS),
    "op2": lambda d: extract.extract(d, "text", model=extract.trained(20, 1)),
    "op4": lambda d: language.identify(d),
    "op6": lambda d: licenses.scan(d),
    "op7": lambda d: quality.apply_rules(d),
    "op8": lambda d: simhash.near_duplicates(d),
    "op8 wide": lambda d: simhash.near_duplicates(d, shingle=5, similarity=0.8),
    "op8 kept": lambda d: simhash.keep_first(d),
    "op9": lambda d: pieces.encode(d, MODEL, check=True),
    "op10": lambda d: mixing.selection(d, mixing.Target({}), [F.lit("d"), F.col("lang"), F.col("source")]),
    "op10 mix": lambda d: mixing.mix(d, mixing.Target({}), [F.lit("d"), F.col("lang"), F.col("source")]),
}


@pytest.mark.parametrize("name", list(OPERATORS))
@pytest.mark.parametrize("text", ["text", "Text"])
def test_clashing_columns(spark, name, text):
    frame = docs(spark, text)
    out = OPERATORS[name](frame)
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if "cut" in out.columns:  # the user's columns come back as they were
        assert {(r["cut"], r["whole"], r["__text"], r["a b"], r["__words"]) for r in rows} == {(1, 2, "mine", 21, 22)}
    if name == "op7":
        assert {r.doc_id: r.n_words for r in rows} == {1: 60, 2: 60, 3: 0, 4: 0, 5: 30}
    if name == "op9":
        assert all(r.ids is not None for r in rows if r.doc_id != 3)
    assert OPERATORS[name](frame.limit(0)).collect() == []


def test_clashing_columns_of_chat_and_vectors(spark):
    rows = spark.range(6).selectExpr("id conv_id", "id % 2 turn", "'user' role", "'User: hi there?' Text", *CLASH.split(", "))
    assert chat.parse(rows, chat.fit(chat.sample(rows))).count() == 6
    vectors = spark.range(6).selectExpr("id Vec_Id", "array(cast(id as double), 1D) embedding", *CLASH.split(", "))
    assert neighbours.search(vectors, F.col("Vec_Id") < 3, 2).count() == 6


def test_letters(spark):
    """Numbers that are word characters are no letters."""
    texts = ["½", "²²", "12 ½", "Ⅷ", "_", "٣", "a", "½ é", "字"]
    net = language.train([TEXT], ["en"])
    rows = language.predict(spark.createDataFrame([(t,) for t in texts], "text string"), net).collect()
    assert [r.lang_pred for r in rows] == ["und"] * 6 + ["en"] * 3 and all(r.score == 0 for r in rows[:6])


def test_stages_keep_the_columns_of_documents(spark):
    frame = docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, "").columns == frame.columns, name
