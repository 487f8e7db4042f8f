"""Re-read a source: replace the raw table of a workspace and profile it again."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from millrace.operators.profile import table_profile
from millrace.sources.files import write_parquet
from millrace.sources.workspace import Workspace


def refresh_source(
    workspace: Workspace, reader: Callable[[], DataFrame], path: str, name: str = ""
) -> tuple[DataFrame, dict[str, Any]]:
    """Land the source as Parquet, make it the raw table and return it with its profile."""
    write_parquet(reader(), path)
    landed = workspace.spark.read.parquet(path)
    workspace.raw, workspace.clean = landed, None
    return landed, table_profile(landed, name)
