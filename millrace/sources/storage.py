"""Small text files (specs, manifests, registries) on whatever file system the cluster uses."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import SparkSession


class SharedFolder:
    """Text files under a folder, through the file system Spark itself uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        return self._path(self.at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str = "") -> list[str]:
        target = self._at(folder) if folder else self._path(self.root)
        if not self._fs.exists(target):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(target))

    def read(self, name: str) -> Any:
        stream = self._fs.open(self._at(name))
        try:
            data = self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
        finally:
            stream.close()
        return json.loads(bytes(data).decode("utf-8"))

    def write(self, name: str, value: Any, overwrite: bool = True) -> bool:
        """Write JSON. With ``overwrite=False`` exactly one of several writers succeeds."""
        payload = json.dumps(value, indent=2, sort_keys=True, default=str).encode("utf-8")
        if not overwrite and self._fs.getScheme() == "file":
            return self._write_local(name, payload)
        try:
            stream = self._fs.create(self._at(name), overwrite)
        except Exception:
            if not overwrite and self.exists(name):
                return False
            raise
        try:
            stream.write(bytearray(payload))
        finally:
            stream.close()
        return True

    def _write_local(self, name: str, payload: bytes) -> bool:
        """A local disk (tests) needs the operating system's exclusive create."""
        path = self._at(name).toUri().getPath()
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(path, "xb") as out:
                out.write(payload)
        except FileExistsError:
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
