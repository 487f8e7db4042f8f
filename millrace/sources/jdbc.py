"""Tables of a remote database through Spark's JDBC source, read in parallel key ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class JdbcSource:
    url: str
    options: dict[str, str] = field(default_factory=dict)

    def _reader(self, spark: SparkSession):
        return spark.read.format("jdbc").option("url", self.url).options(**self.options)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return self._reader(spark).option("query", sql.strip().rstrip(";")).load()

    def table(
        self,
        spark: SparkSession,
        name: str,
        schema: str | None = None,
        limit: int | None = None,
        split_on: str | None = None,
        bounds: tuple[int, int] | None = None,
        partitions: int = 32,
    ) -> DataFrame:
        """A whole table; ``split_on`` reads it as key ranges, their bounds looked up when absent."""
        full = f"{schema}.{name}" if schema else name
        reader = self._reader(spark).option("dbtable", full)
        if split_on:
            low, high = bounds or self.query(
                spark, f"SELECT MIN({split_on}) AS lo, MAX({split_on}) AS hi FROM {full}").first()
            reader = reader.options(partitionColumn=split_on, lowerBound=str(low), upperBound=str(high),
                                    numPartitions=str(partitions))
        df = reader.load()
        return df.limit(limit) if limit else df

    def columns(self, spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
        where = f" AND table_schema = '{schema}'" if schema else ""
        return self.query(
            spark,
            "SELECT column_name, data_type, is_nullable FROM information_schema.columns "
            f"WHERE table_name = '{table}'{where}",
        )

    def tables(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        where = f" WHERE table_schema = '{schema}'" if schema else ""
        return self.query(spark, f"SELECT table_schema, table_name FROM information_schema.tables{where}")


def catalog_tables(spark: SparkSession) -> DataFrame:
    """Tables and views the session can see."""
    rows = [(t.name, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, is_temporary boolean")


def catalog_columns(spark: SparkSession, table: str) -> DataFrame:
    rows = [(table, c.name, c.dataType, bool(c.nullable)) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")
