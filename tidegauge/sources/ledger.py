"""A commit ledger: which units of work (channel and month, fit) a table holds in full.

A unit's data is written first and its ledger row after it, as a small Parquet
file in a folder beside the data.  A run that ends in between leaves data
without a row: the unit counts as undone, is written again over what is there,
and is not read in the meantime.  A unit without any data has a row too (0
rows), so it is not sought again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """The ledger of one table; ``path`` is a folder of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self) -> DataFrame:
        """(unit, rows) of all committed units; of several rows of a unit, the largest count."""
        try:
            rows = self.spark.read.schema("unit string, rows long").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "unit string, rows long")
        return rows.groupBy("unit").agg(F.max("rows").alias("rows"))

    def pending(self, requested: DataFrame, unit: str = "unit") -> DataFrame:
        """The requested rows whose unit is not committed."""
        done = self.done().select(F.col("unit").alias(unit))
        return requested.join(done, unit, "left_anti")

    def commit(self, units: DataFrame) -> None:
        """Append (unit, rows); call it only once the units' data is written."""
        units.select(F.col("unit").cast("string").alias("unit"), F.col("rows").cast("long").alias("rows")).coalesce(1).write.mode("append").parquet(self.path)

    def committed(self, table: DataFrame, unit: str = "unit") -> DataFrame:
        """The rows of ``table`` that belong to committed units."""
        return table.join(self.done().filter("rows > 0").select(F.col("unit").alias(unit)), unit, "left_semi")
