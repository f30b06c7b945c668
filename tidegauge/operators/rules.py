"""Decision rules over the table of gains (one row per analysis, target, model and feature set)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import ranking


def condition_gain(delta: str, pooled_low: str) -> Column:
    """A: the main gain and the lower end of the pooled interval are both above zero."""
    return F.coalesce((F.col(delta) > 0) & (F.col(pooled_low) > 0), F.lit(False))


def condition_stable(below: Column, w: str, top_blocks: str, min_w: float, min_blocks: int) -> Column:
    """B: inconclusive when a block is below the floor, else agreement of blocks and enough top ranks."""
    ok = (F.col(w) >= min_w) & (F.col(top_blocks) >= min_blocks)
    return F.when(below, "inconclusive").when(ok, "pass").otherwise("fail")


def condition_queues(delta: str, queue_deltas: Sequence[str], queue_pos: Sequence[str], floor: int) -> Column:
    """C: same sign in every queue and the main test; waived when a queue is below the floor."""
    enough = F.lit(True)
    for p in queue_pos:
        enough = enough & (F.col(p) >= floor)
    agrees = C.same_sign(F.col(delta), *[F.col(q) for q in queue_deltas])
    return F.when(~F.coalesce(enough, F.lit(False)), "waived").when(agrees, "pass").otherwise("fail")


def condition_importance(importance: str, floor: str) -> Column:
    """D: importance above the placebo floor."""
    return F.coalesce(F.col(importance) > F.col(floor), F.lit(False))


def condition_sign(delta: str, other: str) -> Column:
    """E: a verifier's gain has the same sign as the deciding model's."""
    return F.coalesce(C.same_sign(F.col(delta), F.col(other)), F.lit(False))


def failed_letters(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """Letters of the conditions that do not hold, in order; B must be "pass", C may be waived."""
    return F.concat_ws(
        "", F.when(~a, F.lit("A")), F.when(b != "pass", F.lit("B")), F.when(c == "fail", F.lit("C")), F.when(~d, F.lit("D")), F.when(~e, F.lit("E"))
    )


def verdict(failed: Column, b: Column) -> Column:
    """"yes" when nothing failed, "inconclusive" when only an inconclusive B stands in the way, else "no"."""
    return F.when(failed == "", "yes").when((failed == "B") & (b == "inconclusive"), "inconclusive").otherwise("no")


def add_verdicts(df: DataFrame, verifiers: Sequence[str], plan_verifier: str) -> DataFrame:
    """``failed``, ``relevant`` and ``relevant_plan_rule`` from A, B, C, D and the ``E_<verifier>`` columns."""
    col = F.col
    every = F.lit(True)
    for v in verifiers:
        every = every & col(f"E_{v}")
    letters = lambda e: failed_letters(col("A"), col("B"), col("C"), col("D"), e)
    return df.withColumn("failed", letters(every)).withColumn("relevant", verdict(col("failed"), col("B"))).withColumn(
        "relevant_plan_rule", verdict(letters(col(f"E_{plan_verifier}")), col("B"))
    )


def block_ranks(gains: DataFrame, *, keys: Sequence[str], item: str, blocks: Sequence[str]) -> DataFrame:
    """(keys, block, item, gain, rank): rank of every real item's gain in each block, 1 = largest."""
    cells = F.array(*[F.struct(F.lit(b).alias("block"), F.col(f"delta_{b}").alias("gain")) for b in blocks])
    long = gains.filter(~F.col("is_placebo")).select(*keys, item, F.explode(cells).alias("c")).select(*keys, item, "c.block", "c.gain")
    return long.withColumn("rank", ranking.average_rank_over("gain", [*keys, "block"]))


def relevance_table(
    gains: DataFrame,
    *,
    keys: Sequence[str],
    item: str,
    deciding: str,
    verifiers: dict[str, str],
    blocks: Sequence[str],
    queues: Sequence[str],
    floor: int,
    plan_verifier: str,
    top: int = 3,
    min_w: float = 0.7,
    min_blocks: int = 2,
) -> DataFrame:
    """The relevance rule: one row per (keys, item) with all conditions, ranks and both verdicts.

    ``gains`` columns: ``model``, ``is_placebo``, ``delta_main``, ``ci_pooled_low``,
    ``importance``, ``delta_<block>``/``pos_<block>``, ``delta_<queue>``/``pos_<queue>``.
    ``verifiers`` maps a short name to a model.  Keys hold one row per item, so
    the windows are bounded by the study's item list.
    """
    keys = list(keys)
    lead = gains.filter(F.col("model") == deciding)
    ranks = block_ranks(lead, keys=keys, item=item, blocks=blocks)
    w = ranking.kendall_w(ranks, keys=keys, rater="block", item=item, rank="rank")
    per_item = ranks.groupBy(*keys, item).agg(
        *[F.max(F.when(F.col("block") == b, F.col("rank"))).alias(f"rank_{b}") for b in blocks],
        F.count_if(F.col("rank") <= top).alias("top_blocks"),
    )
    p95 = lead.filter("is_placebo").groupBy(*keys).agg(F.percentile("importance", F.lit(0.95)).alias("placebo_p95"))
    others = gains.filter(~F.col("is_placebo")).groupBy(*keys, item).agg(
        *[F.max(F.when(F.col("model") == m, F.col("delta_main"))).alias(f"delta_{v}") for v, m in verifiers.items()]
    )
    below = F.lit(False)
    for b in blocks:
        below = below | F.coalesce(F.col(f"pos_{b}") < floor, F.lit(True))
    out = (
        lead.filter(~F.col("is_placebo"))
        .join(per_item, [*keys, item])
        .join(others, [*keys, item], "left")
        .join(w, keys)
        .join(p95, keys, "left")
        .withColumn("A", condition_gain("delta_main", "ci_pooled_low"))
        .withColumn("B", condition_stable(below, "kendall_w", "top_blocks", min_w, min_blocks))
        .withColumn("C", condition_queues("delta_main", [f"delta_{q}" for q in queues], [f"pos_{q}" for q in queues], floor))
        .withColumn("D", condition_importance("importance", "placebo_p95"))
    )
    for v in verifiers:
        out = out.withColumn(f"E_{v}", condition_sign("delta_main", f"delta_{v}"))
    out = out.withColumn("block_below_floor", below)
    return add_verdicts(out, list(verifiers), plan_verifier)


def top_positive(final: DataFrame, *, keys: Sequence[str], item: str, gain: str, k: int = 3) -> DataFrame:
    """The up to ``k`` items with the largest positive gain per key, with their place."""
    order = W.partitionBy(*keys).orderBy(F.desc(gain), F.asc(item))
    return final.filter(F.col(gain) > 0).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def readings(
    final: DataFrame, *, keys: Sequence[str], item: str, classes: dict[str, Sequence[str]], regulated: str, driven: str, min_w: float = 0.7
) -> DataFrame:
    """The four pre-defined readings per key, as booleans ``reading_1`` .. ``reading_4`` and the top items.

    1: top dominated by ``regulated`` items and blocks agree.  2: top dominated
    by ``driven`` items, or no item passes A.  3: some item is relevant.  4:
    blocks disagree or one is below the floor.  A class dominates with two
    items in the top.
    """
    keys = list(keys)
    in_class = lambda c: F.col(item).isin(list(classes[c]))
    top = top_positive(final, keys=keys, item=item, gain="delta_main").groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", item))), lambda p: p[item]), ", ").alias("top_items"),
        F.count_if(in_class(regulated)).alias("__reg"),
        F.count_if(in_class(driven)).alias("__load"),
    )
    whole = final.groupBy(*keys).agg(
        F.bool_or("A").alias("__a"), F.bool_or(F.col("relevant") == "yes").alias("__rel"), F.max("kendall_w").alias("kendall_w"),
        F.bool_or("block_below_floor").alias("__below"),
    )
    agree = F.coalesce(F.col("kendall_w") >= min_w, F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.join(top, keys, "left").select(
        *keys,
        F.coalesce("top_items", F.lit("")).alias("top_items"),
        "kendall_w",
        ((zero("__reg") >= 2) & agree).alias("reading_1"),
        ((zero("__load") >= 2) | ~F.col("__a")).alias("reading_2"),
        F.col("__rel").alias("reading_3"),
        (~agree | F.col("__below")).alias("reading_4"),
    )


def signal_survival(mapping: DataFrame, final: DataFrame, *, item: str, target: str, targets: Sequence[str]) -> DataFrame:
    """Each mapped outside signal with the verdict of its item per target; unmapped signals are "not testable"."""
    wide = final.groupBy(item).agg(*[F.max(F.when(F.col(target) == t, F.col("relevant"))).alias(f"survives_{t}") for t in targets])
    joined = mapping.join(wide, item, "left")
    return joined.select(*mapping.columns, *[F.coalesce(f"survives_{t}", F.lit("not testable")).alias(f"survives_{t}") for t in targets])


def mapping_kinds(mapping: DataFrame, *, signal: str, text: str, position: str) -> DataFrame:
    """How many signals have which kind of mapping: first word of the first listed mapping of a signal."""
    first = mapping.groupBy(signal).agg(F.min_by(text, position).alias("__t"))
    return first.groupBy(F.split("__t", "[ :]")[0].alias("kind")).agg(F.count("*").alias("signals"))


def important_without_gain(final: DataFrame) -> DataFrame:
    """Items above the placebo floor of importance whose gain is negative."""
    return final.filter((F.col("importance") > F.col("placebo_p95")) & (F.col("delta_main") < 0))


def passes_by_model(gains: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """How many real items pass A per key and model, and the share of negative main gains."""
    real = gains.filter(~F.col("is_placebo"))
    return real.groupBy(*keys).agg(
        F.count_if(condition_gain("delta_main", "ci_pooled_low")).alias("passes_a"), F.avg((F.col("delta_main") < 0).cast("double")).alias("negative_share")
    )
