"""Registered query and oracle of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import quality
from palimpsest.llm.work import table

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.apply_rules(docs).select(*COLUMNS)


def verdict_sql() -> str:
    parts = []
    for r in quality.RULES:
        below = "1" if r.denominator == "one" else f"greatest({r.denominator}, 1)"
        parts.append(f"CAST({r.numerator} AS DOUBLE) / {below} >= {r.low!r}")
        if r.high != float("inf"):
            parts.append(f"CAST({r.numerator} AS DOUBLE) / {below} <= {r.high!r}")
    return " AND ".join(parts)


def counts_sql(source: str = "documents") -> str:
    """DuckDB text of a query for all counts, keyed by a row number r."""
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {source}),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS gram FROM
        (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c >= 2),
cover AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
            (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
c AS (SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN cover ON w.r = cover.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ({verdict_sql()}) AS kept
FROM (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": counts_sql()}
