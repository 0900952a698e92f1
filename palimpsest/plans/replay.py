"""Rebuilding a version: one lazy plan from the nearest full copy through the later deltas.

Deltas are small beside the table, so Catalyst broadcasts them below its size threshold and the table itself is neither
shuffled nor sorted; above the threshold the joins are shuffled like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.plans.schema import RID, RID_FIELD, converted, quoted
from palimpsest.sources.store import Store

CELL = "__cell_"


def cell_fields(schema: T.StructType, names: list[str]) -> list[T.StructField]:
    """Columns of stored updates: a changed cell is a struct around its value, so that a change to null is one too."""
    return [T.StructField(f"{CELL}{k}", T.StructType([T.StructField("v", schema[c].dataType)])) for k, c in enumerate(names)]


def version_schema(meta: dict) -> T.StructType:
    return T.StructType.fromJson(meta["schema"])


def with_rid(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([RID_FIELD, *fields])


def chain_of(store: Store, version: int) -> tuple[int, bool, list[int]]:
    """(version stored in full, whether by a snapshot, later versions whose deltas lead to version)."""
    full, deltas, at = set(store.snapshots()), [], version
    while at not in full:
        meta = store.metadata(at)
        if "base" in meta["components"]:
            return at, False, deltas[::-1]
        deltas.append(at)
        at = meta["parent"]
    return at, True, deltas[::-1]


def materialize(store: Store, version: int) -> DataFrame:
    """The frame of a version, row ids included."""
    full, by_snapshot, deltas = chain_of(store, version)
    if by_snapshot:  # it carries its own schema, so it outlives the data of its version
        frame = store.spark.read.parquet(store.snapshot_path(full))
    else:
        frame = store.component(full, "base", with_rid(version_schema(store.metadata(full)).fields))
    for v in deltas:
        frame = apply_delta(store, frame, store.metadata(v))
    return frame


def apply_delta(store: Store, frame: DataFrame, meta: dict) -> DataFrame:
    """frame, a parent version, turned into the version that meta describes. The order of the steps matters."""
    version, target, parts = meta["version"], version_schema(meta), meta["components"]
    old = frame.schema
    frame = frame.drop(*meta["removed_columns"])
    if "deletes" in parts:
        gone = store.component(version, "deletes", T.StructType([RID_FIELD]))
        frame = frame.join(gone, RID, "left_anti")
    # Types first: the conversion is what changed cells were held against at commit.
    kept = [f for f in target.fields if f.name in old.fieldNames() and f.name not in meta["added_columns"]]
    frame = frame.select(RID, *[converted(quoted(f.name), old[f.name].dataType, f.dataType).alias(f.name) for f in kept])
    if "updates" in parts:
        names = parts["updates"]
        cells = store.component(version, "updates", with_rid(cell_fields(target, names)))
        frame = frame.join(cells, RID, "left")
        new = {c: f"{CELL}{k}" for k, c in enumerate(names)}
        cell = lambda c: F.when(F.col(new[c]).isNotNull(), F.col(new[c])["v"]).otherwise(quoted(c)).alias(c) if c in new else quoted(c)
        frame = frame.select(RID, *[cell(f.name) for f in kept])
    if "inserts" in parts:
        frame = frame.unionByName(store.component(version, "inserts", with_rid(kept)))
    if "columns" in parts:
        names = meta["added_columns"]
        frame = frame.join(store.component(version, "columns", with_rid([target[c] for c in names])), RID, "left")
    there = set(frame.columns)
    return frame.select(RID, *[(quoted(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields])
