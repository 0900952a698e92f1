"""Small files through Hadoop's file system layer, so that any store Spark can reach will do."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


class StoreError(RuntimeError):
    """A repository, version or component that is missing or in the way."""


class TakenError(StoreError):
    """A file that was to be made once is there already: another writer was first."""


class Files:
    """File operations below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(str(root)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self.root = self._fs.makeQualified(self._path(str(root))).toString().rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def _put(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create_once(self, path: str, text: str) -> None:
        """Make a file that must not exist, as a whole: readers see all of it or nothing, and of two writers one fails.

        The text goes to a file of its own first. Locally a hard link gives it the name, elsewhere a rename, which a file
        system with atomic renames refuses if the name is taken. On an object store, which copies, the file is read again:
        a writer whose text is not there was overtaken. Texts of two writers must therefore differ.
        """
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        self._put(draft, text)
        try:
            if self.exists(path):
                raise TakenError(f"{path} is there already")
            if urlsplit(self.root).scheme == "file":
                try:
                    os.link(*(unquote(urlsplit(p).path) for p in (draft, path)))
                except FileExistsError:
                    raise TakenError(f"{path} is there already") from None
            elif not self._fs.rename(self._path(draft), self._path(path)):
                raise TakenError(f"{path} is there already")
            if self.read_text(path) != text:
                raise TakenError(f"{path} was made by another writer")
        finally:
            self.remove(draft)

    def read_text(self, path: str) -> str:
        if not self.exists(path):
            raise StoreError(f"no such file: {path}")
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def read_json(self, path: str):
        return json.loads(self.read_text(path))
