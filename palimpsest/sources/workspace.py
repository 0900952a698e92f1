"""Where working files go, and how the package reaches the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the session names, for repositories of queries, tests and measurements."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each application.

    Functions that run in workers are named by module, so every worker must be able to import it, wherever the
    driver was started. The archive stays on the driver, which serves it to executors, until the driver ends.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
