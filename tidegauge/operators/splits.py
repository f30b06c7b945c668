"""Temporal train/test splits and label-balanced blocks, as time thresholds.

Nothing is cut by row position: a cut that may not separate equal end times is
the same as "everything up to the first end time where the running count
reaches the target".  So a split is a pair of timestamps per population, and
membership is a comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import ordering
from tidegauge.operators.small import literal_table
from tidegauge.session import materialize


def end_counts(rows: DataFrame, *, population: str, end: str, positive: Column) -> DataFrame:
    """Rows and positives per distinct end time with running and total counts.

    The running sums go through calendar days: a day's end times in one task, and
    one row per day across tasks.
    """
    per_end = rows.groupBy(population, F.col(end).alias("end_at")).agg(F.count("*").alias("n"), F.count_if(positive).alias("pos"))
    day = F.date_trunc("day", F.col("end_at").cast("timestamp"))
    return ordering.running_totals(per_end, [population], "end_at", ["n", "pos"], chunk=day)


def split_limits(rows: DataFrame, *, population: str, end: str, positive: Column, test_frac: float = 0.2) -> DataFrame:
    """One row per population: the last training end, the two block limits, and the last training end of each block.

    Columns ``main_cut``, ``b1``, ``b2``, ``cut1``, ``cut2``, ``cut3``; a NULL
    training limit means an empty training side.
    """
    # read three times below: once per level of cuts
    ran = materialize(end_counts(rows, population=population, end=end, positive=positive), "end-counts")
    share = F.lit(1.0 - test_frac)

    def first_end(cond: Column) -> Column:
        return F.min(F.when(cond, F.col("end_at")))

    target = C.half_even(share * F.col("tot_n"))
    outer = ran.groupBy(population).agg(
        first_end((F.col("run_n") >= target) & (target > 0)).alias("main_cut"),
        first_end(F.col("run_pos") >= F.col("tot_pos") / 3).alias("b1"),
        first_end(F.col("run_pos") >= 2 * F.col("tot_pos") / 3).alias("b2"),
    )
    block = F.when(F.col("end_at") <= F.col("b1"), 1).when(F.col("end_at") <= F.col("b2"), 2).otherwise(3)
    blocked = ran.select(population, "end_at", "n", "run_n").join(outer, population).withColumn("block", block)
    sizes = blocked.groupBy(population, "block").agg(F.min(F.col("run_n") - F.col("n")).alias("before"), F.max("run_n").alias("upto"))
    inner_target = C.half_even(share * (F.col("upto") - F.col("before")))
    inner = (
        blocked.join(sizes, [population, "block"])
        .groupBy(population, "block")
        .agg(first_end((F.col("run_n") - F.col("before") >= inner_target) & (inner_target > 0)).alias("cut"))
        .groupBy(population)
        .agg(*[F.max(F.when(F.col("block") == k, F.col("cut"))).alias(f"cut{k}") for k in (1, 2, 3)])
    )
    return outer.join(inner, population)


def split_ranges(limits: DataFrame, *, population: str) -> DataFrame:
    """(population, split, role, after, upto): members end in ``(after, upto]``; NULL means open."""
    none = F.lit(None)

    def row(split: str, role: str, after: Column, upto: Column, exists: Column) -> Column:
        return F.when(exists, F.struct(F.lit(split).alias("split"), F.lit(role).alias("role"), after.alias("after"), upto.alias("upto")))

    c = F.col
    ts = lambda x: x.cast("timestamp")
    always = F.lit(True)
    rows = [
        row("main", "train", ts(none), ts(c("main_cut")), c("main_cut").isNotNull()),
        row("main", "test", ts(c("main_cut")), ts(none), always),
        row("block1", "train", ts(none), ts(c("cut1")), c("cut1").isNotNull()),
        row("block1", "test", ts(c("cut1")), ts(c("b1")), always),
        row("block2", "train", ts(c("b1")), ts(c("cut2")), c("cut2").isNotNull()),
        row("block2", "test", ts(F.coalesce(c("cut2"), c("b1"))), ts(c("b2")), always),
        row("block3", "train", ts(c("b2")), ts(c("cut3")), c("cut3").isNotNull()),
        row("block3", "test", ts(F.coalesce(c("cut3"), c("b2"))), ts(none), always),
    ]
    exploded = limits.select(population, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r"))
    return exploded.select(population, "r.*")


def assign_splits(rows: DataFrame, ranges: DataFrame, *, population: str, end: str) -> DataFrame:
    """Each row once per split it belongs to (main and one block), with ``split`` and ``role``.

    ``ranges`` has eight rows per population.  They are written first, so Spark
    broadcasts them by their measured size, or else shuffles and splits a
    population that holds most rows.
    """
    ranges = materialize(ranges, "split-ranges")
    at = F.col(end).cast("timestamp")
    inside = (F.col("after").isNull() | (at > F.col("after"))) & (F.col("upto").isNull() | (at <= F.col("upto")))
    return rows.join(ranges, population).filter(inside).drop("after", "upto")


def temporal_splits(rows: DataFrame, *, population: str, end: str, positive: Column, test_frac: float = 0.2) -> DataFrame:
    """Membership of the main split and the three blocks in one go."""
    limits = split_limits(rows, population=population, end=end, positive=positive, test_frac=test_frac)
    return assign_splits(rows, split_ranges(limits, population=population), population=population, end=end)


def split_summary(members: DataFrame, *, by: Sequence[str], end: str, user: str, targets: dict[str, str], failure: Column) -> DataFrame:
    """Rows, positives, prevalence, users, users with a failure and time range per (population, split, role)."""
    aggs = [F.count("*").alias("jobs")]
    for label, suffix in targets.items():
        aggs += [F.count_if(F.col(label) == 1).alias(f"pos_{suffix}"), F.avg(label).alias(f"prev_{suffix}")]
    aggs += [
        F.countDistinct(user).alias("users"),
        F.countDistinct(F.when(failure, F.col(user))).alias("users_with_failure"),
        F.min(end).alias("from_at"),
        F.max(end).alias("to_at"),
    ]
    return members.groupBy(*by).agg(*aggs)


def split_violations(members: DataFrame, *, population: str, end: str, total: DataFrame) -> DataFrame:
    """Broken invariants; an empty result means the splits are sound.

    Training ends before testing in every split, blocks follow each other, and
    the blocks together hold every row.  ``total``: (population, jobs).
    """
    spans = members.groupBy(population, "split", "role").agg(F.min(end).alias("lo"), F.max(end).alias("hi"), F.count("*").alias("n"))
    wide = spans.groupBy(population).agg(
        *[
            F.max(F.when((F.col("split") == s) & (F.col("role") == r), F.col(v))).alias(f"{s}_{r}_{v}")
            for s in ("main", "block1", "block2", "block3")
            for r in ("train", "test")
            for v in ("lo", "hi")
        ],
        F.sum(F.when(F.col("split").startswith("block"), F.col("n")).otherwise(0)).alias("in_blocks"),
    )
    checks = [F.when(F.col(f"{s}_train_hi") >= F.col(f"{s}_test_lo"), F.lit(f"{s}: train not before test")) for s in ("main", "block1", "block2", "block3")]
    for a, b in (("block1", "block2"), ("block2", "block3")):
        ends = F.greatest(f"{a}_train_hi", f"{a}_test_hi") >= F.least(f"{b}_train_lo", f"{b}_test_lo")
        checks.append(F.when(ends, F.lit(f"{a} not before {b}")))
    checks.append(F.when(F.col("in_blocks") != F.col("jobs"), F.lit("blocks do not hold every row")))
    found = wide.join(total, population).select(population, F.explode(F.filter(F.array(*checks), lambda v: v.isNotNull())).alias("violation"))
    return found


def rule_viability(members: DataFrame, *, rule: str, user: str, targets: dict[str, str], main: str, rules: Sequence[str] = ()) -> DataFrame:
    """Per rule: rows, positives per target, positives in every test set, users with a ``main`` positive in
    the main test, and the smallest number of ``main`` positives over the block tests.

    Every rule of ``rules`` has a row, with zeros where nobody passes it."""
    splits = ("main", "block1", "block2", "block3")
    is_main = F.col("split") == "main"
    aggs = [F.count_if(is_main).alias("jobs")]
    for label, suffix in targets.items():
        aggs.append(F.count_if(is_main & (F.col(label) == 1)).alias(f"pos_{suffix}"))
    for s in splits:
        for label, suffix in targets.items():
            aggs.append(F.count_if((F.col("split") == s) & (F.col("role") == "test") & (F.col(label) == 1)).alias(f"{s}_test_pos_{suffix}"))
    hit = is_main & (F.col("role") == "test") & (F.col(main) == 1)
    aggs.append(F.countDistinct(F.when(hit, F.col(user))).alias("users_with_failure_in_main_test"))
    suffix = targets[main]
    blocks = [F.col(f"block{k}_test_pos_{suffix}") for k in (1, 2, 3)]
    counted = members.groupBy(rule).agg(*aggs).withColumn("min_block_pos", F.least(*blocks))
    if not rules:
        return counted
    listed = literal_table(members.sparkSession, [(r,) for r in rules], f"{rule} string")
    return listed.join(counted, rule, "left").fillna(0)


def positives_per_test(members: DataFrame, *, population: str, queue: str, queues: Sequence[str], targets: dict[str, str]) -> DataFrame:
    """(population, split, target, positives) for every test set and, in the main test, for every listed queue.

    Every population of ``members`` has all sets, with zeros where a set has no row.
    """
    tests = members.filter(F.col("role") == "test")
    main_queue = F.when((F.col("split") == "main") & F.col(queue).isin(list(queues)), F.concat(F.lit("main, queue "), F.col(queue).cast("string")))
    tagged = tests.withColumn("__set", F.explode(F.filter(F.array(F.col("split"), main_queue), lambda t: t.isNotNull())))
    cells = F.array(*[F.struct(F.lit(s).alias("target"), (F.col(label) == 1).alias("hit")) for label, s in targets.items()])
    long = tagged.select(population, F.col("__set").alias("split"), F.explode(cells).alias("c"))
    counted = long.groupBy(population, "split", F.col("c.target").alias("target")).agg(F.count_if("c.hit").alias("positives"))
    sets = ["main", "block1", "block2", "block3", *[f"main, queue {q}" for q in queues]]
    cells = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(t).alias("target")) for s in sets for t in targets.values()])
    listed = members.select(population).distinct().select(population, F.inline(cells))
    return listed.join(counted, [population, "split", "target"], "left").fillna(0, ["positives"])


def below_floor(positives: DataFrame, floor: int) -> DataFrame:
    return positives.filter(F.col("positives") < floor)


def cumulative_positives(rows: DataFrame, *, population: str, end: str, positive: Column) -> DataFrame:
    """Running positives at every distinct end time (the last value of a tie)."""
    ran = end_counts(rows, population=population, end=end, positive=positive)
    return ran.select(population, "end_at", F.col("run_n").alias("jobs_so_far"), F.col("run_pos").alias("positives_so_far"))
