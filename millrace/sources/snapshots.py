"""Immutable content-addressed snapshots with a version chain and optimistic concurrency."""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import cols
from millrace.sources.storage import SharedFolder

FIRST = "v0"


class ConflictError(RuntimeError):
    def __init__(self, current: str, expected: str):
        super().__init__(f"expected version {expected!r} but the current version is {current!r}")
        self.current, self.expected = current, expected


@dataclass(frozen=True)
class Commit:
    version_id: str
    snapshot_id: str


def content_id(df: DataFrame) -> tuple[str, int]:
    """Hash of the rows that does not depend on their order, and the row count."""
    hashed = F.xxhash64(*cols(df.columns)).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(hashed).alias("h")).first()
    text = f"{row['n']}|{row['h']}|{df.schema.simpleString()}"
    return hashlib.sha256(text.encode()).hexdigest()[:16], row["n"]


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = SharedFolder(spark, root)

    def manifest(self) -> list[dict[str, Any]]:
        """Commits, oldest first."""
        return [self.store.read(f"manifest/{n}") for n in self.store.names("manifest") if n.endswith(".json")]

    def current(self) -> str:
        entries = self.manifest()
        return entries[-1]["version_id"] if entries else FIRST

    def commit(
        self,
        df: DataFrame,
        expected: str | None = None,
        action: str = "mutation",
        metadata: dict[str, Any] | None = None,
    ) -> Commit:
        """Write the table once and append a version.

        A stale ``expected`` is refused (``*`` matches any version). The manifest entry is created
        exclusively, so of two writers on the same version exactly one wins.
        """
        entries = self.manifest()
        current = entries[-1]["version_id"] if entries else FIRST
        wanted = None if expected is None else expected.strip().strip('"')
        if wanted not in (None, "*") and wanted != current:
            raise ConflictError(current, wanted)
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(self.store.at(folder))
        written = self.spark.read.parquet(self.store.at(folder))
        snapshot, rows = content_id(written)
        same = next((e for e in entries if e["snapshot_id"] == snapshot), None)
        if same:
            self.store.delete(folder)
            folder = same["folder"]
        version = f"v{len(entries) + 1}"
        entry = {"version_id": version, "snapshot_id": snapshot, "parent_version": current, "action": action,
                 "rows": rows, "cols": len(df.columns), "created_at": time.time(), "folder": folder,
                 "metadata": metadata or {}}
        if not self.store.write(f"manifest/{len(entries) + 1:012d}.json", entry, overwrite=False):
            raise ConflictError(self.current(), current)
        return Commit(version, snapshot)

    def read(self, version: str | None = None) -> DataFrame:
        entries = self.manifest()
        chosen = next((e for e in entries if e["version_id"] == version), None) if version else (
            entries[-1] if entries else None)
        if chosen is None:
            raise ValueError(f"no snapshot for version {version!r}")
        return self.spark.read.parquet(self.store.at(chosen["folder"]))

    def history(self) -> DataFrame:
        schema = T.StructType([
            T.StructField("version_id", T.StringType()), T.StructField("snapshot_id", T.StringType()),
            T.StructField("parent_version", T.StringType()), T.StructField("action", T.StringType()),
            T.StructField("rows", T.LongType()), T.StructField("cols", T.LongType()),
            T.StructField("created_at", T.DoubleType()),
        ])
        rows = [tuple(e[f.name] for f in schema) for e in self.manifest()]
        return self.spark.createDataFrame(rows, schema)
