"""Quality rules [native]: a threshold table compiled into one Spark projection.

`measure` adds per-text counts, `apply_rules` compiles a table of ratio rules over those counts
into one boolean expression. Everything is a built-in expression, evaluated in the JVM in the
scan stage: no shuffle, no Python.

Defined results. A null or blank text has zero words, hence fails the base rule. Texts of any length
are measured whole. Repeated rows are measured independently. An empty table gives an empty result.
Columns of the input whose names equal an output column, case aside, are replaced; all others are kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import spare, without

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD_CHAR = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Very frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by this are from or an at not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par au pas sur avec "
    "el y los se del las por con no para su al lo como es una"
).split()


class Rule(NamedTuple):
    """numerator / denominator must lie in [low, high]; a zero denominator counts as one."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: The thresholds; every entry keeps prose of each language the stop words cover.
RULES = (
    Rule("length", "n_words", "one", 20, float("inf")),
    Rule("mean_word", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.10),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, 1.0),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0.0, 0.50),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the ascending starts."""
    reach = F.transform(
        starts,
        lambda s, k: F.when(k + 1 < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, k + 1) - s)).otherwise(WINDOW),
    )
    return F.aggregate(reach, F.lit(0), lambda total, x: total + x)


def _ranked(hashes: Column) -> Column:
    """(hash, position) pairs in order, for texts in which some window occurs twice; else none."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def _repeat_starts(ranked: Column) -> Column:
    """Ascending positions of windows whose hash occurs at least twice.

    ranked must be a column of its own: as an expression it would be evaluated again for every element.
    """
    twin = F.filter(
        ranked,
        lambda x, k: ((k > 0) & (F.get(ranked, k - 1)["h"] == x["h"]))
        | ((k + 1 < F.size(ranked)) & (F.get(ranked, k + 1)["h"] == x["h"])),
    )
    return F.sort_array(F.transform(twin, lambda x: x["i"]))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of COUNTS (long)."""
    keep = without(df.columns, *COUNTS)
    p = spare(df.columns)  # working columns cannot be taken for the user's
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(f"{p}text"))
    out = out.withColumn(f"{p}words", words_of(F.col(f"{p}text")))
    words, body = F.col(f"{p}words"), F.col(f"{p}text")
    n = F.size(words)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD_CHAR))
    out = out.withColumn(f"{p}lines", lines).withColumn(f"{p}hashes", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(f"{p}hashes")  # named twice below, so that Catalyst does not move it into the lambda
    windows = F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(f"{p}windows", windows)
    out = out.withColumn(f"{p}ranked", _ranked(F.col(f"{p}windows")))
    starts = F.when(F.col(f"{p}ranked").isNotNull(), _repeat_starts(F.col(f"{p}ranked")))
    out = out.withColumn(f"{p}starts", F.coalesce(starts, F.array().cast("array<int>")))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col(f"{p}starts")).cast("long").alias("n_repeat_words"),
        F.size(f"{p}lines").cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    # A one-element generator: a later filter on the verdict is not pushed below it, where Catalyst would
    # write the whole chain of array expressions into the predicate and evaluate it again.
    return out.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(counts)))


def compiled(rules=RULES) -> Column:
    """One boolean expression: true when every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        below = F.lit(1.0) if r.denominator == "one" else F.greatest(F.col(r.denominator), F.lit(1)).cast("double")
        ratio = F.col(r.numerator) / below
        verdict = verdict & (ratio >= F.lit(float(r.low)))
        if r.high != float("inf"):
            verdict = verdict & (ratio <= F.lit(float(r.high)))
    return verdict


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """df with COUNTS, base_failed and kept."""
    out = measure(df.drop("base_failed", "kept"), text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & compiled(rules))
