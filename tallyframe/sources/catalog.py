"""Tables of the session's catalog and of SQL databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.sources.files import write_csv

# What writing to an existing table may do.
MODES = {"fail": "error", "replace": "overwrite", "append": "append"}


class Tables:
    """Named tables: list, schema, read, write."""

    def __init__(self, spark: SparkSession, database: str | None = None):
        self.spark, self.database = spark, database

    def _full(self, name: str) -> str:
        return f"{self.database}.{name}" if self.database else name

    def list(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def schema(self, name: str) -> dict[str, str]:
        return dict(self.spark.table(self._full(name)).dtypes)

    def read(self, name: str, limit: int | None = None) -> DataFrame:
        rows = self.spark.table(self._full(name))
        return rows if limit is None else rows.limit(limit)

    def write(self, df: DataFrame, name: str, if_exists: str = "fail") -> None:
        if if_exists not in MODES:
            raise ValueError(f"if_exists is one of {', '.join(MODES)}")
        df.write.mode(MODES[if_exists]).format("parquet").saveAsTable(self._full(name))

    def export(self, name: str, kind: str, path: str) -> str:
        """The whole table as a folder of CSV files (nested values as JSON text) or Parquet files."""
        if kind not in ("csv", "parquet"):
            raise ValueError("a table is exported as csv or parquet")
        rows = self.read(name)
        if kind == "csv":
            return write_csv(rows, path)
        rows.write.mode("overwrite").parquet(path)
        return path

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._full(name)}")


def jdbc_responses(spark: SparkSession, url: str, table: str, survey: str, bounds: tuple[int, int], partitions: int = 16, key: str = "id", **options: str) -> DataFrame:
    """A survey's responses in a SQL database, read in parallel by ranges of a numeric key. The filter runs in the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, **options)
    return reader.load().filter(f"survey_id = '{survey.replace(chr(39), chr(39) * 2)}'")
