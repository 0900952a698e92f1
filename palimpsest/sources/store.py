"""Layout of a repository on disk.

    repository.json          identity, snapshot interval, format
    versions/v00002.json     one manifest for each version: parent, schema, statistics, components, folder of its data
    data/<name>/             inserts/ updates/ deletes/ columns/ cells/ provenance/ base/   Parquet, one folder for each commit
    snapshots/v00002.json    where a version lies in full

Data goes to its final folder, whose name nobody else has, before anything refers to it. A version exists once its
manifest does, and that is one small file, made as a whole and at most once. So a commit that broke off leaves nothing but
a folder that no manifest names, and of two writers of one version the second gets TakenError. The head is the last version
of the unbroken run of manifests that begins with 1; the manifests are the log as well.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from palimpsest.sources.files import Files, StoreError

FORMAT = 2
COMPONENTS = ("base", "inserts", "updates", "deletes", "columns", "cells", "provenance")
LOGGED = ("version", "parent", "timestamp", "message", "stats")


def _name(version: int) -> str:
    return f"v{version:05d}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.files = Files(spark, root)
        self.root = self.files.root
        self._manifests: dict[int, dict] = {}  # a manifest never changes

    @property
    def config_path(self) -> str:
        return self.files.at("repository.json")

    def _manifest(self, version: int) -> str:
        return self.files.at("versions", f"{_name(version)}.json")

    def version_path(self, version: int, *parts: str) -> str:
        """Where the components of a version are."""
        return self.files.at("data", self.metadata(version)["folder"], *parts)

    def exists(self) -> bool:
        return self.files.exists(self.config_path)

    def create(self, config: dict, overwrite: bool = False) -> None:
        if self.exists():
            if not overwrite:
                raise StoreError(f"there is a repository at {self.root}")
            self.files.remove(self.root)
        elif overwrite and self.files.names(self.root):
            raise StoreError(f"{self.root} holds files but no repository; it is not overwritten")
        for part in ("versions", "snapshots", "data"):
            self.files.make(self.files.at(part))
        self.files.create_once(self.config_path, json.dumps({"format": FORMAT, **config, "made": uuid.uuid4().hex}))

    def config(self) -> dict:
        if not self.exists():
            raise StoreError(f"no repository at {self.root}")
        config = self.files.read_json(self.config_path)
        if config.get("format") != FORMAT:
            raise StoreError(f"the repository at {self.root} has format {config.get('format')}, not {FORMAT}")
        return config

    def head(self) -> int:
        there = set(self.files.names(self.files.at("versions")))
        n = 0
        while f"{_name(n + 1)}.json" in there:
            n += 1
        return n

    # --- writing ----------------------------------------------------------------------------------------------

    def draft(self, version: int) -> str:
        """A fresh folder for the data of a version to be."""
        path = self.files.at("data", f"{_name(version)}-{uuid.uuid4().hex}")
        self.files.make(path)
        return path

    @staticmethod
    def write(df: DataFrame, path: str, *metrics) -> DataFrame | tuple[DataFrame, dict]:
        """Write Parquet and read it back with the same schema; with metrics, also what they came to in that same job."""
        if not metrics:
            df.write.parquet(path)
            return df.sparkSession.read.schema(df.schema).parquet(path)
        seen = Observation()
        df.observe(seen, *metrics).write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path), seen.get

    def publish(self, draft: str, version: int, meta: dict) -> None:
        """Make the data of a draft the given version; TakenError if there is one."""
        meta = meta | {"folder": draft.rsplit("/", 1)[-1]}
        self.files.create_once(self._manifest(version), json.dumps(meta, default=str))

    def forget(self, draft: str, version: int) -> None:
        """Remove the data of a commit that broke off, unless its manifest may have got its name all the same."""
        path = self._manifest(version)
        if not self.files.exists(path) or self.files.read_json(path)["folder"] != draft.rsplit("/", 1)[-1]:
            self.files.remove(draft)

    def publish_snapshot(self, version: int, folder: str) -> None:
        self.files.create_once(self.files.at("snapshots", f"{_name(version)}.json"), json.dumps({"folder": folder.rsplit("/", 1)[-1]}))

    # --- reading ----------------------------------------------------------------------------------------------

    def metadata(self, version: int) -> dict:
        if version not in self._manifests:
            self._manifests[version] = self.files.read_json(self._manifest(version))
        return self._manifests[version]

    def snapshots(self) -> list[int]:
        """Versions that are stored in full besides."""
        return sorted(int(n[1:-5]) for n in self.files.names(self.files.at("snapshots")) if n.startswith("v") and n.endswith(".json"))

    def snapshot_path(self, version: int) -> str:
        return self.files.at("data", self.files.read_json(self.files.at("snapshots", f"{_name(version)}.json"))["folder"])

    def component(self, version: int, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.version_path(version, name))

    def history(self) -> list[dict]:
        """Log entries, oldest first."""
        return [{k: self.metadata(v)[k] for k in LOGGED} for v in range(1, self.head() + 1)]

    def bytes(self) -> int:
        return self.files.size(self.root)
