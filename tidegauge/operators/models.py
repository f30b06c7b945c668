"""Fit and score boosted trees and random forests on Spark ML."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import evaluate, ordering, permute
from tidegauge.operators.small import literal_table
from tidegauge.session import ensure_checkpoint_dir, materialize

#: Hyperparameters fixed in advance, no search.  Trees are bounded by depth
#: (2^4 = 16 leaves), the nearest form of the 15-leaf boosted trees.
BOOSTED = {"stepSize": 0.05, "maxIter": 300, "maxDepth": 4, "minInstancesPerNode": 50, "seed": 42}
SECOND_BOOSTED = {**BOOSTED, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
FOREST = {"numTrees": 500, "minInstancesPerNode": 20, "featureSubsetStrategy": "sqrt", "maxDepth": 12, "seed": 42}


@dataclass(frozen=True)
class ModelSpec:
    """A named learner: ``kind`` is "boosted" or "forest", ``params`` override the defaults."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)

    def estimator(self, label: str):
        common = {"labelCol": label, "featuresCol": "features", "checkpointInterval": 10}
        if self.kind == "boosted":
            return GBTClassifier(**{**BOOSTED, **common, **self.params})
        if self.kind == "forest":
            return RandomForestClassifier(**{**FOREST, **common, **self.params})
        raise ValueError(f"unknown model kind: {self.kind}")


@dataclass(frozen=True)
class Analysis:
    """One part of the grid: which population, groups, baseline columns, models and placebo family it uses."""

    name: str
    population: str
    groups: Sequence[str]
    baseline: Sequence[str]
    models: Sequence[ModelSpec]
    placebo: str
    placebo_count: int = 20

    def feature_sets(self) -> dict[str, list[str]]:
        """"B0", one set per group, one per placebo: the columns added to the baseline."""
        from tidegauge.operators.features import stat_columns

        sets: dict[str, list[str]] = {"B0": []}
        sets.update({g: stat_columns(g) for g in self.groups})
        sets.update({f"placebo{k:02d}": stat_columns(f"{self.placebo}{k:02d}") for k in range(self.placebo_count)})
        return sets


def grid(df: DataFrame, analyses: Iterable[Analysis], targets: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """The configuration table: one row per fit (analysis, target, split, model, feature set)."""
    rows = [
        (a.name, t, s, m.name, fs) for a in analyses for t in targets for s in splits for m in a.models for fs in a.feature_sets()
    ]
    return literal_table(df.sparkSession, rows, "analysis string, target string, split string, model string, feature_set string")


def with_missing_marks(df: DataFrame, columns: Sequence[str], floors: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """Columns fit for MLlib, which takes neither NULL nor NaN.

    A missing value becomes a number below the column's minimum (so a split
    can put it on its own side) and a 0/1 mark says so; nothing is imputed.
    """
    made, names = [], []
    for c in columns:
        v = C.nan_to_null(c)
        made += [F.coalesce(v, F.lit(floors[c])).alias(f"x_{c}"), v.isNull().cast("double").alias(f"na_{c}")]
        names += [f"x_{c}", f"na_{c}"]
    return df.select("*", *made), names


def column_floors(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """A value below the minimum of each column, from one aggregate row of the training data."""
    if not columns:
        return {}
    row = df.agg(*[F.min(C.nan_to_null(c)).alias(c) for c in columns]).first()
    return {c: (row[c] if row[c] is not None else 0.0) - 1.0 for c in columns}


def fit_model(train: DataFrame, *, columns: Sequence[str], label: str, spec: ModelSpec) -> tuple[Model, dict[str, float]]:
    """Fit on the rows that have a label.  Returns the model and the column floors it was fitted with."""
    ensure_checkpoint_dir(train.sparkSession)
    known = train.filter(F.col(label).isNotNull())
    floors = column_floors(known, columns)
    ready, names = with_missing_marks(known, columns, floors)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(ready).select("features", label)
    return spec.estimator(label).fit(data), floors


def score_model(model: Model, floors: dict[str, float], test: DataFrame, *, columns: Sequence[str], label: str, keep: Sequence[str]) -> DataFrame:
    """(keep, label, score) for test rows that have a label; score is the positive probability as float."""
    known = test.filter(F.col(label).isNotNull())
    ready, names = with_missing_marks(known, columns, floors)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(ready)
    return model.transform(data).select(*keep, label, vector_to_array("probability")[1].cast("float").alias("score"))


# ------------------------------------------------------------------ many fits over one table of vectors


@dataclass(frozen=True)
class Vectors:
    """All columns of a split as one vector: ``train`` and ``test`` are (key, label, all); ``places`` finds a column's numbers."""

    train: DataFrame
    test: DataFrame
    places: dict[str, list[int]]
    label: str

    def slice(self, df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        at = [i for c in columns for i in self.places[c]]
        return VectorSlicer(inputCol="all", outputCol=name, indices=at).transform(df)


def vectors(rows: DataFrame, *, key: str, label: str, columns: Sequence[str], role: str = "role") -> Vectors:
    """The labelled rows of one split with ``columns`` as a vector, written once for every fit.

    The floors that stand for missing values come from one aggregate over the
    training rows.  A column has two numbers: its value or floor, and the mark.
    """
    known = rows.filter(F.col(label).isNotNull())
    columns = list(dict.fromkeys(columns))
    ready, names = with_missing_marks(known, columns, column_floors(known.filter(F.col(role) == "train"), columns))
    data = VectorAssembler(inputCols=names, outputCol="all").transform(ready).select(key, role, label, "all")
    data = materialize(data, "fit-vectors")
    at = {n: i for i, n in enumerate(names)}
    places = {c: [at[f"x_{c}"], at[f"na_{c}"]] for c in columns}
    return Vectors(data.filter(F.col(role) == "train").drop(role), data.filter(F.col(role) == "test").drop(role), places, label)


def fit_slice(v: Vectors, columns: Sequence[str], spec: ModelSpec) -> Model:
    """Fit on a slice of the vectors."""
    ensure_checkpoint_dir(v.train.sparkSession)
    return spec.estimator(v.label).fit(v.slice(v.train, columns, "features").select("features", v.label))


def score_slice(model: Model, v: Vectors, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, label, score) of the test rows."""
    return model.transform(v.slice(v.test, columns, "features")).select(*keep, v.label, vector_to_array("probability")[1].cast("float").alias("score"))


def importance_slice(model: Model, v: Vectors, ranked: DataFrame, scored: DataFrame, *, key: str, columns: Sequence[str], permuted: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """One row, ``importance``: mean drop of PR-AUC when the ``permuted`` ones of the model's ``columns`` move together.

    ``ranked``: the test vectors with their rank ``__i`` (:func:`ordering.row_index`),
    ranked once for all fits; ``scored``: the model's own scores.
    """
    own = [c for c in columns if c not in permuted]
    n = ranked.count()
    offers = F.array(*[F.struct(F.lit(r).alias("rep"), permute.scramble("__i", n, seed, r).alias("to")) for r in range(repeats)])
    given = v.slice(ranked, permuted, "__given").select("__given", F.explode(offers).alias("o")).select("__given", "o.rep", "o.to")
    base = v.slice(ranked, own, "__own").select("__i", v.label, "__own")
    both = VectorAssembler(inputCols=["__own", "__given"], outputCol="__both").transform(base.join(given, F.col("__i") == F.col("to")))
    # back to the order the model was fitted in; a column has two numbers
    at = {c: 2 * i for i, c in enumerate([*own, *permuted])}
    both = VectorSlicer(inputCol="__both", outputCol="features", indices=[at[c] + j for c in columns for j in (0, 1)]).transform(both)
    again = model.transform(both).select("rep", v.label, vector_to_array("probability")[1].cast("float").alias("score"))
    # the model's own scores are one more copy, so that one pass orders them all
    copies = again.unionByName(scored.select(F.lit(-1).alias("rep"), v.label, "score"))
    ap = evaluate.average_precision(copies, keys=["rep"], y=v.label, score="score", name="ap")
    base_ap = F.max(F.when(F.col("rep") < 0, F.col("ap")))
    return ap.agg((base_ap - F.avg(F.when(F.col("rep") >= 0, F.col("ap")))).alias("importance"))


# ------------------------------------------------------------------ permutation importance of one model


def permuted_copies(df: DataFrame, *, key: str, columns: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """``repeats`` copies of the rows, in each the listed columns moved together by one permutation (``rep``).

    Rows are ranked once by key; the row at rank j hands its columns to rank
    ``permutation rep of j`` (:mod:`permute`).
    """
    ranked = materialize(ordering.row_index(df, [], [key], "__i"), "importance-ranks")
    n = ranked.count()
    offers = F.array(*[F.struct(F.lit(r).alias("rep"), permute.scramble("__i", n, seed, r).alias("to")) for r in range(repeats)])
    given = ranked.select(F.struct(*columns).alias("vals"), F.explode(offers).alias("o")).select("vals", "o.rep", "o.to")
    rest = [c for c in df.columns if c not in columns]
    return ranked.select(*rest, "__i").join(given, F.col("__i") == F.col("to")).select(*rest, "rep", *[F.col(f"vals.{c}").alias(c) for c in columns])


def permutation_importance(
    model: Model,
    floors: dict[str, float],
    test: DataFrame,
    *,
    key: str,
    columns: Sequence[str],
    permuted: Sequence[str],
    label: str,
    repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """One row, ``importance``: mean drop of PR-AUC when ``permuted`` columns are shuffled jointly."""
    known = test.filter(F.col(label).isNotNull()).select(key, label, *columns)
    base = score_model(model, floors, known, columns=columns, label=label, keep=[key])
    base_ap = evaluate.average_precision(base.withColumn("__g", F.lit(1)), keys=["__g"], y=label, score="score", name="base")
    shuffled = permuted_copies(known, key=key, columns=list(permuted), repeats=repeats, seed=seed)
    again = score_model(model, floors, shuffled, columns=columns, label=label, keep=[key, "rep"])
    ap = evaluate.average_precision(again, keys=["rep"], y=label, score="score", name="ap")
    # ``base_ap`` is one row
    return ap.withColumn("__g", F.lit(1)).join(F.broadcast(base_ap), "__g").agg(F.avg(F.col("base") - F.col("ap")).alias("importance"))
