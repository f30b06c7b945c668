"""The study, stage by stage.  Stages meet at written tables, so each can be rerun alone."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import bootstrap as bootstrap_operator
from tidegauge.operators import cohort, completeness, evaluate, features, inventory, models, ordering, ranking, rules, splits, windows
from tidegauge.operators.small import literal_table
from tidegauge.plans import settings
from tidegauge.plans.settings import Study
from tidegauge.session import materialize, scratch_path
from tidegauge.sources import tables
from tidegauge.sources.ledger import Ledger

SUFFIX = {"target_a": "a", "target_b": "b"}
SPLITS = ["main", "block1", "block2", "block3"]
BLOCKS = SPLITS[1:]


def cohort_stage(job_table: DataFrame, study: Study) -> DataFrame:
    """Cohort with runtime, epoch start, GPU flag and both targets."""
    kept = cohort.select_cohort(
        job_table, start="start_time", end="end_time", state="job_state", first_start=study.cohort_start, last_end=study.cohort_end,
        excluded_state=settings.EXCLUDED_STATE, min_runtime_s=study.min_runtime_s,
    )
    flagged = cohort.with_flag(kept.withColumn("qos", F.col("qos").cast("string")), "gpu", F.col("num_gpus_alloc") > 0)
    return cohort.with_targets(flagged, "job_state", {t: (pos, settings.BASELINE_STATE) for t, pos in settings.TARGETS.items()})


def windows_stage(jobs: DataFrame, study: Study) -> DataFrame:
    return windows.node_windows(jobs, job="job_id", t0_ms="t0_ms", nodes="nodes", window_ms=study.window_s * 1000)


def window_readings_stage(readings: DataFrame, job_windows: DataFrame, study: Study) -> DataFrame:
    """Readings inside the windows, one per (channel, job, node, timestamp)."""
    pairs = windows.interval_join(
        readings, job_windows, node="node", ts="ts_ms", t0="t0_ms", t1="t1_ms", bucket_ms=study.window_s * 1000
    )
    # a timestamp repeated on a node keeps its smallest value; one primitive per key, so copies combine before the shuffle
    return pairs.groupBy("channel", "job_id", "node", "ts_ms", "t0_ms").agg(F.min("value").alias("value"))


def refresh_window_readings(spark: SparkSession, root: str, out: str, job_windows: DataFrame, study: Study) -> list[tuple[str, str]]:
    """Extract the (channel, month) units that ``out`` does not hold in full; returns them.  Read them by :func:`window_readings`."""
    wanted = literal_table(spark, [(c, m) for c in study.channels for m in study.months], "channel string, month string")

    def extract(units: list[tuple[str, str]]) -> DataFrame:
        parts = None
        for month in sorted({m for _, m in units}):
            readings = tables.lake_readings(spark, root, channels={c: study.channels[c] for c, m in units if m == month}, months=[month])
            part = window_readings_stage(readings, job_windows, study).withColumn("month", F.lit(month))
            parts = part if parts is None else parts.unionByName(part)
        return materialize(parts, "window-readings")

    return tables.refresh_units(spark, out, f"{out.rstrip('/')}_ledger", wanted, extract, directories=["channel", "month"])


def window_readings(spark: SparkSession, out: str) -> DataFrame:
    """The extracted readings of all units that were written to the end."""
    return tables.committed_units(spark, out, f"{out.rstrip('/')}_ledger", directories=["channel", "month"]).drop("month")


_READING = {"channel": "channel", "node": "node", "ts_ms": "ts_ms", "value": "value"}


def refresh_inventory(spark: SparkSession, root: str, out: str, study: Study) -> list[tuple[str, str]]:
    """Keep the inventory's state of every (channel, month) below ``out``: a new month is read alone.  Returns the units that were read."""
    wanted = literal_table(spark, [(c, m) for c in study.channels for m in study.months], "channel string, month string")

    def extract(units: list[tuple[str, str]]) -> DataFrame:
        parts = None
        for month in sorted({m for _, m in units}):
            readings = tables.lake_readings(spark, root, channels={c: study.channels[c] for c, m in units if m == month}, months=[month])
            part = inventory.interval_state(readings, **_READING, max_interval_s=study.max_interval_s).withColumn("month", F.lit(month))
            parts = part if parts is None else parts.unionByName(part)
        return materialize(parts, "inventory-state")

    return tables.refresh_units(spark, out, f"{out.rstrip('/')}_ledger", wanted, extract, directories=["channel", "month"], sort_by=["interval_s", "e_ts_ms", "e_node"])


def merged_inventory_stage(spark: SparkSession, out: str, study: Study) -> DataFrame:
    """The inventory of all months that :func:`refresh_inventory` has read to the end, without the lake."""
    state = tables.committed_units(spark, out, f"{out.rstrip('/')}_ledger", directories=["channel", "month"]).drop("month")
    cells, nodes = inventory.merge_states(state, **_READING, max_interval_s=study.max_interval_s)
    return _with_source(inventory.inventory_of(cells, nodes, channel="channel", max_interval_s=study.max_interval_s, cumulative_share=settings.CUMULATIVE_SHARE), study)


def inventory_stage(readings: DataFrame, study: Study) -> DataFrame:
    return _with_source(inventory.channel_inventory(readings, **_READING, max_interval_s=study.max_interval_s, cumulative_share=settings.CUMULATIVE_SHARE), study)


def _with_source(inv: DataFrame, study: Study) -> DataFrame:
    sources = F.create_map(*[F.lit(x) for c in study.channels for x in (c, study.source(c))])
    return inv.withColumn("source", sources[F.col("channel")])


def completeness_stage(jobs: DataFrame, job_windows: DataFrame, window_readings: DataFrame, inv: DataFrame, study: Study) -> dict[str, DataFrame]:
    """Fractions, typical delivery, rule membership, viability, outcome and flags.

    Typical delivery uses the whole cohort, rules and flags its GPU jobs.
    """
    used = inv.filter(~F.col("constant"))
    names = sorted(r.channel for r in used.select("channel").collect())  # at most one name per channel
    gpu = jobs.filter("gpu")
    counts = completeness.reading_counts(window_readings.filter(F.col("channel").isin(names)), ["channel", "job_id", "node"])
    fractions = completeness.node_fractions(counts, used.select("channel", "cadence_s"), channel="channel", window_s=study.window_s)
    per_job = materialize(
        completeness.job_fractions(fractions, completeness.nodes_per_job(job_windows, job="job_id"), job="job_id", channel="channel"), "job-fractions"
    )
    typical = completeness.typical_delivery(fractions, channel="channel", share_at=settings.TYPICAL_LEVEL)
    thresholds = completeness.rule_thresholds(typical, settings.RULES_FIXED, channel="channel", relative=settings.RULES_RELATIVE)
    members = materialize(completeness.rule_membership(per_job, thresholds, job="job_id", channel="channel", jobs=gpu), "rule-members")
    placed = splits.temporal_splits(gpu.join(members, "job_id"), population="rule", end="end_time", positive=F.col("target_a") == 1)
    asked = [*settings.RULES_FIXED, *settings.RULES_RELATIVE]
    viability = splits.rule_viability(placed, rule="rule", user="user_id", targets=SUFFIX, main="target_a", rules=asked)
    outcome = completeness.choose_rule(
        viability, completeness.typical_test(typical, settings.TYPICAL_LEVEL), floor=study.floor, strict="R80", relative="Rrel", fallback="R1"
    )
    sources = {s: [c for c in names if study.source(c) == s] for s in dict.fromkeys(study.plugin_source.values())}
    flags = completeness.completeness_table(
        gpu, per_job, members, job="job_id", channel="channel", channels=names,
        rules={"R1": "complete", "R80": "complete_strict"}, sources={s.lower(): c for s, c in sources.items() if c},
    )
    return {"typical": typical, "viability": viability, "outcome": outcome, "flags": flags, "fractions": per_job, "members": members}


def rules_report(outcome: DataFrame) -> DataFrame:
    """One line per rule with block counts joined by "/"."""
    blocks = lambda t: F.concat_ws("/", *[F.col(f"block{k}_test_pos_{t}").cast("string") for k in (1, 2, 3)])
    return outcome.select(
        "rule", "jobs", blocks("a").alias("block_test_pos_a"), blocks("b").alias("block_test_pos_b"), "users_with_failure_in_main_test", "outcome"
    )


def populations_report(jobs: DataFrame, flags: DataFrame) -> DataFrame:
    """Jobs, users, positives and prevalence of the reference, GPU, complete and strict populations."""
    joined = jobs.join(flags.select("job_id", "complete", "complete_strict"), "job_id", "left")
    tagged = cohort.tag_rows(
        joined,
        {"reference": F.lit(True), "gpu": F.col("gpu"), "complete": F.col("complete") == 1, "strict": F.col("complete_strict") == 1},
    )
    return cohort.label_summary(tagged, ["population"], SUFFIX, "user_id")


def features_stage(jobs: DataFrame, flags: DataFrame, window_readings: DataFrame, inv: DataFrame, study: Study) -> tuple[DataFrame, list[str]]:
    """One row per GPU job: ids, labels, request baseline, group statistics and the three placebo families."""
    used = inv.filter(~F.col("constant")).select("channel", "cadence_s")
    gpu = jobs.filter("gpu")
    mine = window_readings.join(gpu.select("job_id"), "job_id", "left_semi").join(used, "channel")
    series = features.window_series(mine, job="job_id", channel="channel", node="node", ts="ts_ms", t0="t0_ms", value="value", cadence_s="cadence_s")
    grouped = features.group_series(series, study.groups, job="job_id", channel="channel", composed=study.composed)
    telemetry = features.wide_stats(features.group_stats(grouped, job="job_id"), list(study.groups), job="job_id")
    ids = ["job_id", "user_id", "end_time", "job_state", "target_a", "target_b", "num_nodes_alloc"]
    base = gpu.select(*dict.fromkeys([*ids, *settings.REQUEST_CATEGORIES, *settings.REQUEST_NUMBERS]))
    base, names = features.request_columns(
        base, categories={c: features.category_list(base, c) for c in settings.REQUEST_CATEGORIES}, numeric=settings.REQUEST_NUMBERS
    )
    bad = features.forbidden_columns(names, settings.FORBIDDEN)
    if bad:
        raise ValueError(f"the request baseline holds forbidden columns: {bad}")
    flag_columns = [c for c in ("complete", "complete_strict", "has_ganglia", "has_ipmi") if c in flags.columns]
    table = materialize(features.assemble(base, flags.select("job_id", *flag_columns), telemetry, job="job_id"), "features")
    ipmi = study.groups_of("IPMI") or list(study.groups)
    families = {
        "complete": (table.filter("complete = 1"), list(study.groups), study.seed),
        "cohort": (table, ipmi, study.seed + settings.COHORT_SEED_OFFSET),
        "strict": (table.filter("complete_strict = 1"), list(study.groups), study.seed + settings.STRICT_SEED_OFFSET),
    }
    out = table
    for pop, (rows, groups, seed) in families.items():
        made = features.placebos(rows, key="job_id", groups=groups, count=study.n_placebos, seed=seed, name=f"placebo_{pop}")
        out = out.join(made, "job_id", "left")
    return out, names


def splits_stage(table: DataFrame) -> DataFrame:
    """(population, split, role) membership of every feature row, main split and blocks, for the three populations."""
    tagged = cohort.tag_rows(table, {"complete": F.col("complete") == 1, "cohort": F.lit(True), "strict": F.col("complete_strict") == 1})
    return splits.temporal_splits(tagged, population="population", end="end_time", positive=F.col("target_a") == 1)


def analyses(study: Study, request: Sequence[str], boosted: dict | None = None, forest: dict | None = None) -> list[models.Analysis]:
    """The three analyses: primary and sensitivity with all models, secondary with the deciding one."""
    trio = [
        models.ModelSpec("HGB", "boosted", boosted or {}),
        models.ModelSpec("RF", "forest", forest or {}),
        models.ModelSpec("LGBM", "boosted", {**models.SECOND_BOOSTED, **(boosted or {})}),
    ]
    groups = list(study.groups)
    return [
        models.Analysis("primary", "complete", groups, list(request), trio, "placebo_complete", study.n_placebos),
        models.Analysis("secondary", "cohort", study.groups_of("IPMI") or groups, [*request, "has_ganglia"], trio[:1], "placebo_cohort", study.n_placebos),
        models.Analysis("sensitivity", "strict", groups, list(request), trio, "placebo_strict", study.n_placebos),
    ]


def fit_stage(
    members: DataFrame,
    analysis: models.Analysis,
    target: str,
    *,
    key: str = "job_id",
    seed: int = 42,
    split_names: Sequence[str] = SPLITS,
    sets: Sequence[str] | None = None,
    folder: str | None = None,
    workers: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Fit and score every (split, model, feature set) of an analysis; importance on the main split.

    The columns of a split are assembled to one vector table; a fit takes its
    slice of it.  ``workers`` fits run at a time, each in a scheduler pool of its
    own (fair, where ``spark.scheduler.mode`` says so).  A fit writes its scores
    and importance below ``folder`` and is then committed to a ledger there: a
    run with the same folder goes on where the last one ended, and fits nothing
    twice.  Without a folder a fresh one below the shared folder is taken.

    Returns (predictions, importance), read from those tables.
    """
    spark = members.sparkSession
    folder = (folder or scratch_path(spark, "fits")).rstrip("/")
    ledger, lock = Ledger(spark, f"{folder}/ledger"), threading.Lock()
    label = f"target_{target}"
    chosen = {n: c for n, c in analysis.feature_sets().items() if sets is None or n in sets}
    unit = lambda split, model, name: "|".join([analysis.name, target, split, model, name])
    done = {r.unit for r in ledger.done().collect()}  # one row a fit
    rows = members.filter((F.col("population") == analysis.population) & F.col(label).isNotNull())

    for split in split_names:
        todo = [(spec, name) for spec in analysis.models for name in chosen if unit(split, spec.name, name) not in done]
        if not todo:
            continue
        every = [*analysis.baseline, *[c for _, name in todo for c in chosen[name]]]
        v = models.vectors(rows.filter(F.col("split") == split), key=key, label=label, columns=every)
        ranked = materialize(ordering.row_index(v.test, [], [key], "__i"), "fit-ranks") if split == "main" else None

        def fit(job, split=split, v=v, ranked=ranked) -> None:
            spec, name = job
            this = unit(split, spec.name, name)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{threading.get_ident() % workers}")
            columns = [*analysis.baseline, *chosen[name]]
            model = models.fit_slice(v, columns, spec)
            tags = [F.lit(this).alias("unit"), F.lit(split).alias("split"), F.lit(spec.name).alias("model"), F.lit(name).alias("feature_set")]
            scores = f"{folder}/scores/fit={hashlib.md5(this.encode()).hexdigest()}"
            models.score_slice(model, v, columns, [key]).select(key, label, *tags, "score").write.mode("overwrite").parquet(scores)
            if split == "main" and chosen[name]:
                scored = spark.read.parquet(scores)
                drop = models.importance_slice(model, v, ranked, scored, key=key, columns=columns, permuted=chosen[name], seed=seed)
                drop.select(*tags, "importance").write.mode("overwrite").parquet(scores.replace("/scores/", "/importance/"))
            with lock:  # two appends to one folder at a time would end each other
                ledger.commit(spark.createDataFrame([(this, 1)], "unit string, rows long"))

        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(inheritable_thread_target(spark)(fit), todo))

    mine = F.col("unit").startswith(f"{analysis.name}|{target}|")
    asked = F.col("split").isin(list(split_names)) & F.col("feature_set").isin(list(chosen)) & F.col("model").isin([m.name for m in analysis.models])
    schema = f"{key} {dict(members.dtypes)[key]}, unit string, split string, model string, feature_set string, score float, fit string"
    preds = ledger.committed(spark.read.schema(schema).parquet(f"{folder}/scores").filter(mine & asked)).select(key, "split", "model", "feature_set", "score")
    imps = None
    if "main" in split_names and any(chosen.values()):
        schema = "unit string, split string, model string, feature_set string, importance double, fit string"
        imps = ledger.committed(spark.read.schema(schema).parquet(f"{folder}/importance").filter(mine & asked)).select("model", "feature_set", "importance")
    return preds, imps


def score_table(predictions: DataFrame, *, keys: Sequence[str], queue: str, sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(keys, model, feature_set, split, queue, score, tp, fp): one pass over the predictions, a row per distinct score."""
    names = ["model", "feature_set"]
    return evaluate.score_cells(predictions, keys=[*keys, *names, "split", queue], y="y", score="score", set_keys=names, sets=sets)


def booted_rows(predictions: DataFrame) -> DataFrame:
    """The rows that are resampled: the main test and the pooled blocks."""
    return evaluate.pooled(predictions, split="split", parts=BLOCKS).filter(F.col("split").isin("main", "pooled"))


def booted_clusters(predictions: DataFrame, *, keys: Sequence[str], cluster: str) -> DataFrame:
    """The numbered clusters of :func:`booted_rows`, written."""
    slots = bootstrap_operator.indexed_clusters(booted_rows(predictions), keys=[*keys, "split"], cluster=cluster)
    return materialize(slots, "bootstrap-clusters")


def gains_stage(
    predictions: DataFrame,
    importance: DataFrame,
    *,
    keys: Sequence[str],
    cluster: str,
    queue: str,
    queues: Sequence[str],
    n_boot: int,
    seed: int = 42,
    bootstrap: str | None = None,
    sets: Sequence[Sequence[str]] | None = None,
    cells: DataFrame | None = None,
    slots: DataFrame | None = None,
) -> DataFrame:
    """One row per (keys, model, feature set): main, pooled, block and queue gains, intervals, Holm p, importance.

    ``predictions``: (keys, job, cluster, queue, split, model, feature_set,
    score, y), a written table.  ``importance``: (keys, model, feature_set,
    importance).  ``bootstrap``: an SQL condition on the rows that get
    intervals (all of them by default); the point figures are for every set.
    ``sets``: (model, feature set) of each place, where ``score`` is an array.
    ``cells``: a written :func:`score_table` of the predictions, if known; every
    point figure is made from it.  ``slots``: :func:`booted_clusters`, if known
    (without ``bootstrap``).
    """
    keys = list(keys)
    row = [*keys, "model", "feature_set"]
    if cells is None:
        cells = materialize(score_table(predictions, keys=keys, queue=queue, sets=sets), "score-table")
    pooled_cells = evaluate.pooled(cells, split="split", parts=BLOCKS)
    tests = evaluate.subset_tags(pooled_cells, split="split", main="main", queue=queue, queues=queues)
    tests = materialize(evaluate.added_cells(tests, [*row, "split"], "score"), "test-cells")
    ap = evaluate.average_precision_of_cells(tests, keys=[*row, "split"], score="score", name="ap")
    pos = tests.groupBy(*row, "split").agg(F.sum("tp").cast("bigint").alias("pos"))
    point = evaluate.gain_over_baseline(ap, keys=[*keys, "model", "split"], set_col="feature_set", baseline="B0", value="ap", name="delta")
    names = ["main", "pooled", *BLOCKS, *[f"queue {q}" for q in queues]]
    wide = evaluate.wide_by(point.join(pos, [*row, "split"]), row, "split", names, ["delta", "pos"])
    both = F.col("split").isin("main", "pooled")
    booted, known_cells, known_ap = booted_rows(predictions), tests.filter(both), ap.filter(both)
    if bootstrap is not None:
        if sets is not None:
            booted, sets = bootstrap_operator.unfolded(booted, set_keys=["model", "feature_set"], score="score", sets=sets), None
        booted, known_cells, known_ap, slots = booted.filter(bootstrap), None, None, None
    ci = evaluate.paired_gains(
        booted, test_keys=[*keys, "split"], set_keys=["model", "feature_set"], set_col="feature_set", baseline="B0", y="y", score="score",
        cluster=cluster, n_boot=n_boot, seed=seed, sets=sets, cells=known_cells, ap=known_ap, slots=slots,
    )
    spread = evaluate.wide_by(ci, row, "split", ["main", "pooled"], ["ci_low", "ci_high", "p"])
    spread = spread.select(*row, *[F.col(f"ci_{side}_{s}").alias(f"ci_{s}_{side}") for s in ("main", "pooled") for side in ("low", "high")], "p_main", "p_pooled")
    # a set without a row of importance is a mistake of the caller, not a set to leave out
    known = importance.select(*row, "importance", F.lit(True).alias("__known"))
    missing = F.raise_error(F.concat(F.lit("no importance for "), F.concat_ws(", ", *row))).cast("double")
    joined = wide.join(spread, row, "left").join(known, row, "left")
    joined = joined.withColumn("importance", F.when(F.col("__known"), F.col("importance")).otherwise(missing)).drop("__known")
    joined = joined.withColumn("is_placebo", evaluate.is_placebo("feature_set"))
    # a result table of the study: the rules below read it several times
    return materialize(ranking.holm_real_only(joined, [*keys, "model"], "p_pooled", "p_holm_pooled"), "gains")


def verdict_stage(gains: DataFrame, *, keys: Sequence[str], queues: Sequence[str], floor: int, verifiers: dict[str, str] | None = None) -> DataFrame:
    """The relevance table of one or more analyses."""
    return rules.relevance_table(
        gains, keys=keys, item="feature_set", deciding="HGB", verifiers=verifiers or {"rf": "RF", "lgbm": "LGBM"}, blocks=BLOCKS,
        queues=[f"queue{q}" for q in queues], floor=floor, plan_verifier="rf",
    )
