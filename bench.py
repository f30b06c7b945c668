"""Headline queries, timed.  Prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8).  Each query is planned and run to the end into a no-op sink; short
ones run twice and the faster run counts, so JVM warm-up is left out.

``lake_pass`` is the raw pass (inventory and window extraction) over a lake that
Spark derives from the order lines; its rows per second are reported beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from tidegauge.operators import evaluate, inventory, models, windows
from tidegauge.queries import REGISTRY, base, model_queries, split_queries
from tidegauge.session import local_session, materialize

HEADLINE = [
    "cohort_filter",
    "window_interval_join",
    "window_features",
    "channel_inventory",
    "line_channel_inventory",
    "dedup_keep_first",
    "asof_forward",
    "completeness_fraction",
    "placebo_permutation",
    "temporal_split",
    "split_summary",
    "average_precision",
    "average_rank_with_ties",
    "distributed_quantiles",
    "previous_job_on_node",
    "paired_gain_ci",
]
COPIES = 16


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def lake(spark, sf):
    """Order lines as readings, repeated at shifted times until the lake is worth timing."""
    lines = base.line_readings(spark, sf)
    shifted = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    ts = F.col("ts_ms") + F.pmod(F.xxhash64("node", "ts_ms", "value", "i"), F.lit(86_400_000))
    return materialize(shifted.select("channel", "node", ts.alias("ts_ms"), "value"), "bench-lake")


def lake_pass(spark, sf, readings) -> None:
    inv = inventory.channel_inventory(readings, channel="channel", node="node", ts_ms="ts_ms", value="value")
    run(inv)
    wins = base.jobs(spark, sf).join(base.job_nodes(spark, sf), "job_id").select(
        "job_id", "node", (F.unix_millis("start_time")).alias("t0_ms"), (F.unix_millis("start_time") + 1_200_000).alias("t1_ms")
    )
    wins = materialize(wins, "bench-windows")
    run(
        windows.interval_join(
            readings, wins, node="node", ts="ts_ms", t0="t0_ms", t1="t1_ms", bucket_ms=1_200_000
        )
    )


def gain_part(spark, sf):
    """One model, two sets beside the baseline, main and pooled: a ninth of ``paired_gain_ci``."""
    rows = split_queries.scored(spark, sf, pooled=True, models=["HGB"]).filter("split IN ('main', 'pooled') AND feature_set IN ('B0', 'quantity', 'balance')")
    return evaluate.paired_gains(
        rows, test_keys=["split"], set_keys=["model", "feature_set"], set_col="feature_set", baseline="B0", y="y", score="score", cluster="user_id", n_boot=1000
    )


def seconds_per_fit(spark, sf, fits: int = 2) -> float:
    """Boosted trees of ten rounds, fitted and scored on slices of one vector table that is there already."""
    columns = [*model_queries.REQUEST, *model_queries.ADDED]
    v = models.vectors(model_queries._rows(spark, sf), key="job_id", label="target_a", columns=columns)
    start = time.perf_counter()
    for i in range(fits):
        run(models.score_slice(models.fit_slice(v, columns[: len(columns) - i], model_queries.BOOSTED), v, columns[: len(columns) - i], ["job_id"]))
    return round((time.perf_counter() - start) / fits, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=4 * int(cpus), memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")  # one machine: keep every core busy
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            run(REGISTRY[name].run(spark, sf))
            taken = round(time.perf_counter() - start, 3)
            times[name] = min(taken, times.get(name, taken))
            if taken > 8:
                break
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    start = time.perf_counter()
    run(gain_part(spark, sf))
    part = round(time.perf_counter() - start, 3)
    per_fit = seconds_per_fit(spark, sf)
    readings = lake(spark, sf)
    rows = readings.count()
    for _ in range(2):
        start = time.perf_counter()
        lake_pass(spark, sf, readings)
        taken = round(time.perf_counter() - start, 3)
        times["lake_pass"] = min(taken, times.get("lake_pass", taken))
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
        "paired_gain_ci_part": part,
        "seconds_per_fit_10_rounds": per_fit,
        "lake_rows": rows,
        "lake_rows_per_sec": round(rows / times["lake_pass"]),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
