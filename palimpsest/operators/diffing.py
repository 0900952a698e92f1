"""Differences of two versions that carry row ids.

`change_frame` is the one primitive: a full outer join on the row id that says of every row whether it was inserted,
deleted, updated or stayed the same, and which cells changed. Statistics, delta components and audits are projections of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.schema import RID, column_diff, differs, quoted, user_schema

INSERTED, DELETED, UPDATED, SAME = "I", "D", "U", "S"


def change_frame(old: DataFrame, new: DataFrame, check: bool = False) -> DataFrame:
    """(__rid__, status, changed array<string>, old struct of common columns, new struct of all columns).

    With check, also `twin`: whether the id is that of an earlier row of new as well. It needs no exchange of its own.
    """
    before, after = user_schema(old), user_schema(new)
    common = column_diff(before, after).common
    a = old.select(RID, F.struct(*[quoted(c).alias(c) for c in common] or [F.lit(1).alias("__none")]).alias("old"))
    b = new.select(RID, F.struct(*[quoted(c).alias(c) for c in after.names]).alias("new"))
    if check:
        b = b.withColumn("twin", F.row_number().over(Window.partitionBy(RID).orderBy(F.lit(1))) > 1)
    both = a.join(b, RID, "full_outer")
    cell = lambda side, c: F.col(side).getField(c)
    flags = [F.when(differs(cell("old", c), cell("new", c), before[c].dataType, after[c].dataType), F.lit(c)) for c in common]
    inside = F.col("old").isNotNull() & F.col("new").isNotNull()
    changed = F.when(inside, F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")).otherwise(F.array().cast("array<string>"))
    more = [F.coalesce("twin", F.lit(False)).alias("twin")] if check else []
    both = both.select(RID, changed.alias("changed"), "old", "new", *more)
    status = F.when(F.col("old").isNull(), INSERTED).when(F.col("new").isNull(), DELETED).when(F.size("changed") > 0, UPDATED).otherwise(SAME)
    return both.select(RID, status.alias("status"), "changed", "old", "new", *more)


def row_diff(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """Row ids that were appended, deleted and kept; each a lazy frame of ids."""
    a, b = old.select(RID), new.select(RID)
    return {"appended": b.join(a, RID, "left_anti"), "deleted": a.join(b, RID, "left_anti"), "unchanged": b.join(a, RID, "left_semi")}


def changed_rows(changes: DataFrame) -> DataFrame:
    """Row ids of updated rows."""
    return changes.filter(F.col("status") == UPDATED).select(RID)


def changed_columns(changes: DataFrame) -> DataFrame:
    """(column, n_rows): columns that differ in some updated row, and in how many."""
    return changes.select(F.explode("changed").alias("column")).groupBy("column").agg(F.count("*").alias("n_rows"))


def cell_changes(changes: DataFrame, columns: list[str]) -> DataFrame:
    """(__rid__, column, old_val, new_val): every changed cell, values as text."""
    text = lambda side, c: _text(F.col(side).getField(c), changes.schema[side].dataType[c].dataType)
    cells = [F.struct(F.lit(c).alias("column"), text("old", c).alias("old_val"), text("new", c).alias("new_val")) for c in columns]
    if not cells:
        return changes.select(RID, F.lit("").alias("column"), F.lit("").alias("old_val"), F.lit("").alias("new_val")).limit(0)
    hit = F.filter(F.array(*cells), lambda x: F.array_contains(F.col("changed"), x["column"]))
    rows = changes.filter(F.col("status") == UPDATED).select(RID, F.explode(hit).alias("c"))
    return rows.select(RID, "c.column", "c.old_val", "c.new_val")


def _text(value, t):
    nested = any(x in t.simpleString() for x in ("<", "variant"))
    return F.to_json(value) if nested else value.cast("string")


def counts(changes: DataFrame) -> dict[str, int]:
    """Rows added, deleted and updated, in one aggregate."""
    return summary(changes, [])[0]


def summary(changes: DataFrame, columns: list[str]) -> tuple[dict[str, int], list[str]]:
    """`counts`, and which of the columns differ in some updated row, in the same aggregate."""
    return summed(changes.agg(*measures(columns)).first().asDict(), columns)


def measures(columns: list[str]) -> list[Column]:
    """The aggregates of `summary`."""
    rows = [F.count_if(F.col("status") == s).alias(s) for s in (INSERTED, DELETED, UPDATED)]
    return [*rows, *[F.coalesce(F.bool_or(F.array_contains("changed", c)), F.lit(False)).alias(f"c{k}") for k, c in enumerate(columns)]]


def summed(row: dict, columns: list[str]) -> tuple[dict[str, int], list[str]]:
    hit = [c for k, c in enumerate(columns) if row.get(f"c{k}")]
    return {"added": row.get(INSERTED) or 0, "deleted": row.get(DELETED) or 0, "updated": row.get(UPDATED) or 0}, hit
