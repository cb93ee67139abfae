"""Scorers: a seeded forest, any estimator of ``pyspark.ml``, and a deterministic rule.

A scorer is ``scorer(train, schema, seed) -> apply``, and ``apply(table, name)`` adds the score
column ``name`` to a feature table. Because applying a model is a narrow projection, the models of
all seeds are applied to the target in one pass, as one score column per seed: the ensemble mean
needs no shuffle, and per-seed metrics unpivot the columns on the way into their aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.catalog import FeatureSchema
from driftline.operators import forest

Apply = Callable[[DataFrame, str], DataFrame]
Scorer = Callable[[DataFrame, FeatureSchema, int], Apply]
KEEP = ("event_id", "run_id", "scenario", "label", "y", "t_us", "phase")


def encoder_stages(schema: FeatureSchema) -> list:
    """Numeric columns as they are, categories one-hot; a category unseen in training is all zero."""
    stages = []
    inputs = list(schema.numeric)
    if schema.categorical:
        indexed = [f"{c}_index" for c in schema.categorical]
        encoded = [f"{c}_onehot" for c in schema.categorical]
        stages.append(
            StringIndexer(inputCols=schema.categorical, outputCols=indexed, handleInvalid="keep")
        )
        # The indexer's extra slot for unseen values is last, so dropping it encodes them as zeros.
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True))
        inputs += encoded
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def onehot_features(train: DataFrame, table: DataFrame, schema: FeatureSchema, keep: Sequence[str]) -> DataFrame:
    model = Pipeline(stages=encoder_stages(schema)).fit(train)
    return model.transform(table).select(*keep, vector_to_array("features").alias("features"))


def estimator_scorer(make: Callable[[int], Estimator]) -> Scorer:
    """Any ``pyspark.ml`` classifier, built per seed with label ``y``.

    The score is the probability of class 1, or the hard prediction if there is no probability.
    """

    def fit(train: DataFrame, schema: FeatureSchema, seed: int) -> Apply:
        model = Pipeline(stages=[*encoder_stages(schema), make(seed)]).fit(train)

        def apply(table: DataFrame, name: str) -> DataFrame:
            scored = model.transform(table)
            hard = "probability" not in scored.columns
            value = F.col("prediction") if hard else vector_to_array("probability")[1]
            return scored.select(*table.columns, value.alias(name))

        return apply

    return fit


def forest_scorer(trees: int = 200, max_depth: int = 15) -> Scorer:
    """Random forest per seed. Depth is bounded: each level is a pass over the counted training rows."""

    def fit(train: DataFrame, schema: FeatureSchema, seed: int) -> Apply:
        cells = forest.Cells.count(train, schema)
        grown = forest.grow(cells, seed, trees, max_depth)
        return lambda table, name: forest.score(cells.encoding, {name: grown}, table)

    return fit


def rule_scorer() -> Scorer:
    """Score 1 where the first numeric feature is positive: needs no training."""

    def fit(train: DataFrame, schema: FeatureSchema, seed: int) -> Apply:
        hit = (F.col(schema.numeric[0]) > 0).cast("double")
        return lambda table, name: table.withColumn(name, hit)

    return fit


def score_column(seed: int) -> str:
    return f"score_{seed}"


def apply_all(table: DataFrame, models: dict[int, Apply]) -> DataFrame:
    """Kept columns plus one score column per seed, in a single pass over ``table``."""
    out = table
    for seed, apply in models.items():
        out = apply(out, score_column(seed))
    kept = [c for c in KEEP if c in table.columns]
    return out.select(*kept, *[score_column(s) for s in models])


def by_seed(wide: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """One row per event and seed; a narrow step, fused with the aggregate that follows."""
    pairs = F.array(*[F.struct(F.lit(s).alias("seed"), F.col(score_column(s)).alias("score")) for s in seeds])
    kept = [c for c in wide.columns if not c.startswith("score_")]
    return wide.select(*kept, F.explode(pairs).alias("_s")).select(*kept, "_s.seed", "_s.score")


def ensemble_mean(wide: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Mean score per event, added up in seed order so that equal inputs give equal means."""
    total = F.lit(0.0)
    for seed in seeds:
        total = total + F.col(score_column(seed))
    kept = [c for c in wide.columns if not c.startswith("score_")]
    return wide.select(*kept, (total / F.lit(float(len(seeds)))).alias("score"))
