"""Readers and writers.  Projections and filters are left to the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidegauge.functions import columns as C
from tidegauge.operators.ordering import sized
from tidegauge.sources.ledger import Ledger

LAKE_KEYS = ("year_month", "plugin", "metric")


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of only the named columns."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df if columns is None else df.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line and a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lake_readings(
    spark: SparkSession,
    root: str,
    *,
    channels: dict[str, str],
    months: Sequence[str] | None = None,
    nodes: Iterable[int] | None = None,
) -> DataFrame:
    """Readings of the listed channels (channel -> plugin) from a lake laid out by month, plugin and metric.

    One scan for all channels: month, plugin and metric prune directories, a
    node list is pushed to the files.  Returns (channel, source, node, ts_ms,
    value) with ``value`` as double.
    """
    raw = spark.read.parquet(root)
    if months is not None:
        raw = raw.filter(F.col("year_month").isin(list(months)))
    by_plugin: dict[str, list[str]] = {}
    for channel, plugin in channels.items():
        by_plugin.setdefault(plugin, []).append(channel)
    wanted = F.lit(False)
    for plugin, names in by_plugin.items():
        wanted = wanted | ((F.col("plugin") == plugin) & F.col("metric").isin(names))
    raw = raw.filter(wanted)
    if nodes is not None:
        raw = raw.filter(F.col("node").isin([str(n) for n in nodes]))
    return raw.select(
        F.col("metric").alias("channel"),
        F.col("plugin").alias("source"),
        F.col("node").cast("int").alias("node"),
        C.epoch_ms("timestamp").alias("ts_ms"),
        C.nan_to_null("value").alias("value"),
    )


def read_several(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Several Parquet tables in one scan: ``columns`` and ``__place``, where a row stands.

    ``__place`` orders rows by listed path, file and row in the file.  It comes
    from the files themselves, so it does not depend on how the scan is cut.
    """
    file = F.col("_metadata.file_path")
    plain = [p.split("://", 1)[-1].rstrip("/") + "/" for p in paths]
    number = F.coalesce(*[F.when(file.contains(p) | file.endswith(p.rstrip("/")), F.lit(i)) for i, p in enumerate(plain)], F.lit(len(plain)))
    place = F.struct(number.alias("path"), file.alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.read.parquet(*paths).select(*columns, place.alias("__place"))


def first_in_files(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows of a key, the one that stands first (:func:`read_several`): one aggregation with map-side combine.

    Rows are dealt out by place first, to tasks of a counted number of rows: an aggregation of
    rows sorts all rows of its task, and a task of the scan has as many as its files hold.
    """
    rest = [c for c in df.columns if c not in keys and c != "__place"]
    first = sized(df, df.count(), "__place").groupBy(*keys).agg(F.min_by(F.struct(*rest), "__place").alias("__r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns if c != "__place"])


def only_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys`` (semi join), for key lists too long for an ``IN``."""
    return df.join(keys, list(on), "left_semi")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table.  Sorting inside files sharpens min/max pruning for later reads."""
    out = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_result_csv(df: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header; only the finished rows meet in one task."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_windows(df: DataFrame, path: str, *, directories: Sequence[str] = ("channel",), sort_by: Sequence[str] = ("job_id", "node", "ts_ms")) -> None:
    """Window readings in directories, replacing only the directories present in ``df``."""
    (
        _salted(df, list(directories), list(sort_by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*directories)
        .parquet(path)
    )


def refresh_units(spark: SparkSession, path: str, ledger_path: str, wanted: DataFrame, extract, *, directories: Sequence[str], sort_by: Sequence[str] = ("job_id", "node", "ts_ms")) -> list[tuple]:
    """Bring a table in directories up to date: extract, write and commit the wanted units it does not hold in full.

    ``wanted`` has a row per unit with the columns ``directories`` (a listed
    set, such as channels and months); ``extract`` takes the list of their
    values and returns the rows of those units.  Returns the units that were
    written.  Read the table through :func:`committed_units`.
    """
    names = list(directories)
    ledger = Ledger(spark, ledger_path)
    unit = F.concat_ws("|", *[F.col(d).cast("string") for d in names])
    todo = ledger.pending(wanted.select(*names).distinct().withColumn("unit", unit))
    rows = sorted(tuple(r[d] for d in names) for r in todo.collect())
    if rows:
        write_windows(extract(rows), path, directories=names, sort_by=sort_by)
        held = _existing(spark, path)
        counts = spark.createDataFrame([], "unit string, rows long") if held is None else held.groupBy(unit.alias("unit")).agg(F.count("*").alias("rows"))
        ledger.commit(todo.select("unit").join(counts, "unit", "left").select("unit", F.coalesce("rows", F.lit(0)).alias("rows")))
    return rows


def committed_units(spark: SparkSession, path: str, ledger_path: str, *, directories: Sequence[str]) -> DataFrame:
    """The rows of all units that were written to the end."""
    unit = F.concat_ws("|", *[F.col(d).cast("string") for d in directories])
    return Ledger(spark, ledger_path).committed(spark.read.parquet(path).withColumn("unit", unit)).drop("unit")


def write_lake(df: DataFrame, path: str, *, sort_by: Sequence[str] = ("node", "timestamp")) -> None:
    """Raw readings as a lake: one directory per month, plugin and metric, a few sorted files in each."""
    _salted(df, list(LAKE_KEYS), list(sort_by)).write.mode("overwrite").partitionBy(*LAKE_KEYS).parquet(path)


#: Rows that one task writes into a directory.
FILE_ROWS = 4_000_000


def _salted(df: DataFrame, directories: Sequence[str], sort_by: Sequence[str], file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows of one directory spread over as many tasks as its counted rows need, sorted inside each.

    The salt is a hash of the whole sort key, so a node with most of the rows is
    spread like any other.  ``df`` is read twice: write it first if it is dear.
    """
    counts = df.groupBy(*[F.col(d).alias(f"__d_{d}") for d in directories]).agg(F.ceil(F.count("*") / F.lit(file_rows)).alias("__salts"))
    same = [F.col(d).eqNullSafe(F.col(f"__d_{d}")) for d in directories]
    salted = df.join(counts, same).select(*df.columns, F.pmod(F.xxhash64(*sort_by), F.col("__salts")).alias("__salt"))
    spread = salted.repartition(*[F.col(d) for d in directories], F.col("__salt")).drop("__salt")
    return spread.sortWithinPartitions(*directories, *sort_by)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None where there is no folder, or one without any file of data."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def missing_keys(spark: SparkSession, path: str, requested: DataFrame, key: str) -> DataFrame:
    """Requested keys a table does not hold yet; all of them when there is no table.

    Any other trouble with the table (a missing column, no access) is an error.
    """
    table = _existing(spark, path)
    if table is None:
        return requested
    present = table.select(key).distinct()
    return requested.join(present.withColumn(key, F.col(key).cast(dict(requested.dtypes)[key])), key, "left_anti")
