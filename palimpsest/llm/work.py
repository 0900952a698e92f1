"""Shared working space, names and session helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Arrow batches are kept to so many bytes (and one row), so that a batch of very long texts fits a Python worker.
ARROW_BYTES = 1 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A temporary one is set only where it names none and all runs on this machine."""
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts lineage the way checkpoint() does; the files outlive a lost executor and go when the application ends.
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with the folder, for a caller that discards it sooner."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    leave_nothing(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def leave_nothing(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends; until then a lazy frame may still read it."""
    system, target = _target(spark, path)
    system.deleteOnExit(target)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder now."""
    system, target = _target(spark, path)
    system.delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ARROW_BYTES, never raising the bound.

    It stays with the session: results are lazy, and the bound counts when they run. It changes no result of anything.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if now <= 0 or now > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- names -----------------------------------------------------------------------------------------------------------


def without(columns: Iterable[str], *taken: str) -> list[str]:
    """The columns whose names Spark tells from all of taken: case does not count."""
    names = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in names]


def position(df: DataFrame, name: str) -> int:
    """Where the column is that Spark would find under name: case does not count."""
    return [c.lower() for c in df.columns].index(name.lower())


def spare(columns: Iterable[str], stem: str = "__") -> str:
    """A beginning for names of working columns that no column has."""
    lower = [c.lower() for c in columns]
    while any(c.startswith(stem) for c in lower):
        stem += "_"
    return stem
