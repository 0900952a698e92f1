"""Canonical tokens: what two cells must share to count as equal when rows are matched by content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.plans.schema import is_numeric, quoted

NULL_TOKEN = "\x00null"


@dataclass(frozen=True)
class CanonConfig:
    round_decimals: int | None = 6
    case_insensitive: bool = False
    strip_strings: bool = True


def token(value: Column, t: T.DataType, cfg: CanonConfig) -> Column:
    """The cell as text. NaN is null; numbers of all types meet as doubles, integers exactly; strings are trimmed."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = value.cast("string")
    elif is_numeric(t):
        x = F.nanvl(value.cast("double"), F.lit(None))
        x = x if cfg.round_decimals is None else F.bround(x, cfg.round_decimals)
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        text = F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    elif isinstance(t, T.StringType):
        text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "") if cfg.strip_strings else value
        text = F.lower(F.upper(text)) if cfg.case_insensitive else text  # upper first: it writes out the likes of ß
    elif isinstance(t, T.BinaryType):
        text = F.hex(value)
    elif any(x in t.simpleString() for x in ("<", "variant")):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL_TOKEN))


def content_key(df: DataFrame, columns: list[str], cfg: CanonConfig) -> Column:
    """128 bits of the canonical row: a struct of two longs."""
    tokens = [token(quoted(c), df.schema[c].dataType, cfg) for c in columns] or [F.lit("")]
    return F.struct(F.xxhash64(F.lit(1), *tokens).alias("a"), F.xxhash64(F.lit(2), *tokens).alias("b"))
