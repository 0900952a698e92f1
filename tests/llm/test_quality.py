import random
import re

from palimpsest.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for k in range(len(words) - 7):
        where.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + d for v in where.values() if len(v) > 1 for k in v for d in range(8)}
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    got = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_stop_words": stop, "one": 1,
    }
    got["base_failed"] = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    fine = all(r.low <= got[r.numerator] / max(1, got[r.denominator]) <= r.high for r in quality.RULES)
    got["kept"] = fine and not got["base_failed"]
    return got


def test_counts_and_verdict_equal_definition(spark):
    rng = random.Random(1)
    vocabulary = ["the", "The", "of", "x", "é", "###", "a|b", "word", "ß<>", " ", " y", "und"]
    texts = [None, "", " \t\r\n\x0b\x0c", "\n\n", "one", "a\n a\na\n\na \n", "the " * 5000, "line of the text\n" * 40, "x\u0085y z"]
    for n in (5, 19, 20, 21, 40, 200, 2000):
        for size in (2, 4, 12):
            texts.append("".join(rng.choice(vocabulary[:size]) + rng.choice(SPACE) * rng.randint(1, 2) for _ in range(n)))
    passage = " ".join(f"w{k}" for k in range(30))
    texts += [f"{passage} {' '.join(f'v{k}' for k in range(n))} {passage}" for n in (10, 60, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' kept", "1 n_words", "2 `odd name`")
    for r in quality.apply_rules(df).collect():
        want = brute(texts[r.doc_id])
        assert {k: r[k] for k in want if k != "one"} == {k: v for k, v in want.items() if k != "one"}, texts[r.doc_id]


def test_null_ids_repeats_and_empty(spark):
    t = "the cat of the house and the dog of the garden are in the town by the sea with one more word to go now"
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, None)], "doc_id long, text string")
    got = quality.apply_rules(df).select("doc_id", "kept").collect()
    assert sorted((r.doc_id or -1, r.kept) for r in got) == [(-1, True), (1, True), (1, True), (2, False)]
    assert quality.apply_rules(df.limit(0)).collect() == []


def test_no_python_and_no_shuffle_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").repartition(2)
    plan = quality.apply_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("kept")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan) and df
