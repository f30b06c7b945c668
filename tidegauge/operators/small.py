"""Tables of constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of constants as a plan of literals: no Python rows are shipped and its tiny size is known to the planner."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    if not structs:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")
