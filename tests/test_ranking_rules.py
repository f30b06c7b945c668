import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ranking, rules
from tidegauge.operators.small import literal_table

# ---- known answers: block ranks of ten groups and the W they give (primary a, b; strict a, b) ----
RANKS = {
    ("primary", "a", 0.4694): [[10, 2, 3, 4, 5, 7, 9, 6, 1, 8], [6, 8, 2, 5, 3, 1, 7, 10, 4, 9], [5, 7, 2, 4, 6, 10, 9, 1, 3, 8]],
    ("primary", "b", 0.5367): [[4, 5, 6, 1, 3, 10, 9, 7, 2, 8], [9, 3, 4, 5, 2, 6, 10, 8, 1, 7], [4, 6, 7, 3, 9, 2, 5, 8, 1, 10]],
    ("strict", "a", 0.2566): [[1, 3, 2, 6, 4, 10, 9, 8, 7, 5], [5, 7, 6, 3, 2, 1, 9, 8, 4, 10], [3, 4, 6, 2, 10, 9, 5, 1, 8, 7]],
    ("strict", "b", 0.6875): [[9, 5, 6, 1, 4, 2, 7, 8, 3, 10], [3, 4, 6, 2, 1, 8, 5, 9, 7, 10], [7, 6, 8, 3, 4, 2, 5, 9, 1, 10]],
}

# ---- known answers, target a of the primary table: delta_main, ci_pooled_low, delta_rf, delta_lgbm, importance, B, C -> failed ----
FLOOR_A = 0.009142247481674965
TABLE = [
    ("mem_active", -0.0019866, -0.1655170, 0.0354876, -0.0057280, 0.0050561, "fail", "pass", "ABDE"),
    ("swap_free", -0.0022826, -0.0480195, -0.0111930, -0.0125898, 0.0001873, "fail", "pass", "ABD"),
    ("cpu_wio", -0.0011501, -0.0151782, -0.0039206, -0.0020277, -0.0044448, "fail", "pass", "ABD"),
    ("proc_run", -0.0193388, -0.0518110, 0.0123271, -0.0208967, -0.0418045, "fail", "pass", "ABDE"),
    ("load_one", 0.0050335, -0.0527279, 0.0453978, -0.0003283, 0.0109675, "fail", "fail", "ABCE"),
    ("gpu_core_temp", -0.0093928, -0.0655990, 0.0419309, -0.0200875, -0.0013505, "fail", "pass", "ABDE"),
    ("gpu_mem_temp", -0.0025881, -0.1044695, 0.0672285, -0.0035284, -0.0372291, "fail", "pass", "ABDE"),
    ("fan", -0.0096645, -0.0960373, -0.0078455, -0.0172540, 0.0066576, "fail", "fail", "ABCD"),
    ("node_power", 0.0365456, -0.0220287, 0.0729075, 0.0293362, 0.0070516, "fail", "pass", "ABD"),
    ("inlet_temp", -0.0184217, -0.1038340, -0.0220547, -0.0249950, -0.0027716, "fail", "pass", "ABD"),
]


def test_holm_known_answer_and_placebos_left_out(spark):
    df = spark.createDataFrame([("a", 0.01, False), ("b", 0.04, False), ("c", 0.03, False), ("d", 0.2, False), ("x", 0.001, True)], "g string, p double, is_placebo boolean")
    got = {r.g: r.h for r in ranking.holm_real_only(df, [], "p", "h").collect()}
    assert [got[g] for g in "abcd"] == pytest.approx([0.04, 0.09, 0.09, 0.2]) and got["x"] is None


def test_kendall_known_answers(spark):
    data = [(f"{a}{t}", str(b), i, float(r), w) for (a, t, w), m in RANKS.items() for b, row in enumerate(m) for i, r in enumerate(row)]
    data += [("same", str(b), i, float(i), 1.0) for b in range(3) for i in range(1, 6)]
    data += [("opposite", str(b), i, float(i if b == 0 else 6 - i), 0.0) for b in range(2) for i in range(1, 6)]
    df = spark.createDataFrame(data, "k string, rater string, item int, rank double, want double")
    got = ranking.kendall_w(df, keys=["k"], rater="rater", item="item", rank="rank")
    for r in got.join(df.select("k", "want").distinct(), "k").collect():
        assert r.kendall_w == pytest.approx(r.want, abs=5e-5), r.k


def test_kendall_undefined_when_all_tied(spark):
    df = spark.createDataFrame([(str(b), i, 2.0) for b in range(3) for i in range(3)], "rater string, item int, rank double")
    assert ranking.kendall_w(df, keys=[], rater="rater", item="item", rank="rank").first().kendall_w is None


def test_ranks_top_three_and_chance(spark):
    df = spark.createDataFrame([(5.0,), (3.0,), (3.0,), (1.0,)], "v double").withColumn("r", ranking.average_rank_over("v", []))
    assert sorted(r.r for r in df.collect()) == [1.0, 2.5, 2.5, 4.0]
    assert spark.range(1).select(ranking.chance_top_in_two_of_three(3, 10)).first()[0] == pytest.approx(0.216)
    long = spark.createDataFrame([(i, float(r)) for m in [RANKS[("primary", "b", 0.5367)]] for row in m for i, r in enumerate(row)], "item int, rank double")
    got = {r.item: r.t for r in ranking.top_memberships(long, keys=[], item="item", rank="rank", k=3, name="t").collect()}
    assert [got[i] for i in range(10)] == [0, 1, 0, 2, 2, 1, 0, 0, 3, 0]


def test_rule_columns_of_the_known_table(spark):
    df = spark.createDataFrame(TABLE, "g string, delta_main double, ci_pooled_low double, delta_rf double, delta_lgbm double, importance double, B string, C string, want string")
    df = (
        df.withColumn("placebo_p95", F.lit(FLOOR_A))
        .withColumn("A", rules.condition_gain("delta_main", "ci_pooled_low"))
        .withColumn("D", rules.condition_importance("importance", "placebo_p95"))
        .withColumn("E_rf", rules.condition_sign("delta_main", "delta_rf"))
        .withColumn("E_lgbm", rules.condition_sign("delta_main", "delta_lgbm"))
    )
    for r in rules.add_verdicts(df, ["rf", "lgbm"], "rf").collect():
        assert r.failed == r.want and r.relevant == "no" and r.relevant_plan_rule == "no"


def test_verdict_is_inconclusive_only_when_b_alone_fails(spark):
    cases = [("", "pass", "yes"), ("B", "inconclusive", "inconclusive"), ("B", "fail", "no"), ("AB", "inconclusive", "no")]
    df = literal_table(spark, cases, "failed string, b string, want string")
    assert all(r.v == r.want for r in df.withColumn("v", rules.verdict(F.col("failed"), F.col("b"))).collect())


def test_queue_condition_is_waived_below_the_floor(spark):
    cases = [(0.1, 0.2, 0.3, 100, 100, "pass"), (0.1, -0.2, 0.3, 100, 100, "fail"), (0.1, -0.2, 0.3, 99, 100, "waived"), (0.1, None, 0.3, 100, 100, "fail")]
    df = spark.createDataFrame(cases, "d double, q1 double, q2 double, p1 int, p2 int, want string")
    assert all(r.c == r.want for r in df.withColumn("c", rules.condition_queues("d", ["q1", "q2"], ["p1", "p2"], 100)).collect())


def test_readings(spark):
    rows = [("a", "fan", 0.3, True, "yes", 0.8, False), ("a", "inlet", 0.2, False, "no", 0.8, False), ("a", "load", 0.1, False, "no", 0.8, False)]
    rows += [("b", "fan", -0.1, False, "no", 0.9, True), ("b", "load", 0.1, False, "no", 0.9, True)]
    df = spark.createDataFrame(rows, "target string, g string, delta_main double, A boolean, relevant string, kendall_w double, block_below_floor boolean")
    got = {r.target: r for r in rules.readings(df, keys=["target"], item="g", classes={"hw": ["fan", "inlet"], "ld": ["load", "mem"]}, regulated="hw", driven="ld").collect()}
    active = {t: [k for k in (1, 2, 3, 4) if r[f"reading_{k}"]] for t, r in got.items()}
    assert active == {"a": [1, 3], "b": [2, 4]} and got["a"].top_items == "fan, inlet, load"


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, 4.0)], "x double, y double")
    got = ranking.spearman(df.withColumn("k", F.lit(1)), keys=["k"], x="x", y="y").first().spearman
    assert got == pytest.approx(0.7378647873726218)


def test_holm_leaves_untested_items_null(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", None)], "g string, p double").withColumn("k", F.lit(1))
    got = {r.g: r.p_holm for r in ranking.holm(df, ["k"], "p").collect()}
    assert got == {"a": pytest.approx(0.02), "b": pytest.approx(0.02), "c": None}
