"""Named tables of a workspace as temporary views, and SQL over them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_LIMIT = re.compile(r"\blimit\s+\d+\s*\Z", re.IGNORECASE)


def table_name(name: Any) -> str:
    """Safe lower-case identifier for a table."""
    text = str(name or "").strip()
    if text.lower() in ("", "none", "null"):
        return "primary_table"
    safe = re.sub(r"\W", "_", text)
    return (f"t_{safe}" if safe[0].isdigit() else safe).lower()


class Workspace:
    """Tables by name. The active table is the cleaned one where it exists, else the raw one."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.raw: DataFrame | None = None
        self.clean: DataFrame | None = None

    def register(self, name: str, df: DataFrame) -> str:
        safe = table_name(name)
        df.createOrReplaceTempView(safe)
        self.tables[safe] = df
        return safe

    def register_all(self, tables: dict[str, DataFrame]) -> list[str]:
        return [self.register(n, d) for n, d in tables.items()]

    def drop(self, name: str) -> bool:
        safe = table_name(name)
        self.tables.pop(safe, None)
        return self.spark.catalog.dropTempView(safe)

    def active(self) -> DataFrame:
        chosen = self.clean if self.clean is not None else self.raw
        if chosen is None:
            raise ValueError("the workspace holds no table")
        return chosen

    def sql(self, query: str, limit: int | None = None, args: dict[str, Any] | None = None) -> DataFrame:
        """Run SQL over the registered tables; a limit applies only where the text has none."""
        text = query.strip().rstrip(";")
        if not text:
            raise ValueError("empty query")
        out = self.spark.sql(text, args=args) if args else self.spark.sql(text)
        return out.limit(limit) if limit and not _LIMIT.search(text) else out

    def sql_with_total(self, query: str, limit: int = 100) -> tuple[DataFrame, int]:
        return self.sql(query, limit), self.sql(query).count()

    def materialize_sql(self, query: str, path: str) -> DataFrame:
        """Write a query result and make it the active table."""
        self.sql(query).write.mode("overwrite").parquet(path)
        self.clean = self.spark.read.parquet(path)
        return self.clean

    def listing(self) -> Iterable[str]:
        return sorted(self.tables)
