"""Columns and types of table versions; nothing here runs a job."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RID = "__rid__"
RID_FIELD = T.StructField(RID, T.StringType(), False)


class ColumnDiff(NamedTuple):
    added: list[str]
    removed: list[str]
    common: list[str]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def user_fields(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if f.name != RID]


def relaxed(t: T.DataType) -> T.DataType:
    """The type with null allowed at every level, as Parquet gives it back."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(relaxed(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(relaxed(t.keyType), relaxed(t.valueType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True) for f in t.fields])
    return t


def user_schema(df: DataFrame) -> T.StructType:
    """The schema without row ids, null allowed everywhere."""
    return T.StructType([T.StructField(f.name, relaxed(f.dataType), True) for f in user_fields(df.schema)])


def check_names(df: DataFrame) -> None:
    if RID in df.columns:
        raise ValueError(f"the column name {RID} is reserved")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("column names must differ, case aside")
    if not df.columns:
        raise ValueError("a version needs a column")


def column_diff(old: T.StructType, new: T.StructType) -> ColumnDiff:
    """Added and common columns in the new order, removed ones in the old order."""
    before, after = [f.name for f in user_fields(old)], [f.name for f in user_fields(new)]
    return ColumnDiff([c for c in after if c not in before], [c for c in before if c not in after], [c for c in after if c in before])


def type_changes(old: T.StructType, new: T.StructType) -> list[dict[str, str]]:
    return [
        {"column": c, "old_type": old[c].dataType.simpleString(), "new_type": new[c].dataType.simpleString()}
        for c in column_diff(old, new).common
        if old[c].dataType != new[c].dataType
    ]


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def comparable(value: Column, t: T.DataType) -> Column:
    """value in a form that <=> accepts: maps and variants, anywhere inside, as canonical text."""
    text = t.simpleString()
    if "map<" in text:
        if isinstance(t, T.MapType) and "map<" not in t.valueType.simpleString():
            return F.array_sort(F.map_entries(value))
        return F.to_json(F.struct(value.alias("v")))
    if "variant" in text:
        return F.to_json(value)
    return value


def converted(value: Column, old: T.DataType, new: T.DataType) -> Column:
    """The conversion that replay applies when a column changes type; null where there is none."""
    if old == new:
        return value
    return value.try_cast(new)


def differs(old: Column, new: Column, old_type: T.DataType, new_type: T.DataType) -> Column:
    """Whether a cell must be stored again.

    Of equal types: unless null-safe equal. Of changed types: if replay's conversion would not give the new value, or the
    two numbers differ before conversion, or a number became a text or the like and is not null on both sides.
    """
    if old_type == new_type:
        return ~comparable(old, old_type).eqNullSafe(comparable(new, new_type))
    lost = ~comparable(converted(old, old_type, new_type), new_type).eqNullSafe(comparable(new, new_type))
    plain = lambda t: is_numeric(t) or isinstance(t, T.BooleanType)
    if is_numeric(old_type) and is_numeric(new_type):
        return lost | ~old.eqNullSafe(new)
    if plain(old_type) and plain(new_type):
        return lost | ~old.cast("double").eqNullSafe(new.cast("double"))
    if plain(old_type) != plain(new_type) or isinstance(old_type, T.StringType) != isinstance(new_type, T.StringType):
        return lost | ~(old.isNull() & new.isNull())
    return lost
