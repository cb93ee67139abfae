"""The frozen transfer experiment: fit per seed on the source, evaluate the ensemble on the target."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.catalog import FAMILIES, FEATURE_SCHEMAS, feature_schema
from driftline.functions.scalar import is_attack, scenario_family
from driftline.operators.bootstrap import bootstrap_intervals
from driftline.operators.contracts import failures, metric_preconditions, result_contract, split_contract, union_checks
from driftline.operators.features import build_features
from driftline.operators.ordered import checkpointed
from driftline.operators.pools import main_pool, pool_audit, stress_pool
from driftline.operators.ranking import (
    PRIMARY_METRICS,
    auc,
    counted_scores,
    long_metrics,
    primary_metrics,
)
from driftline.operators.splits import TRAIN, VALIDATION, split_by_run, split_profile
from driftline.operators.thresholds import (
    apply_threshold,
    counted_predictions,
    median_min_max,
    seed_counts,
    stress_fpr,
    threshold_at_fpr,
    threshold_metrics,
    validation_fpr,
)
from driftline.plans.scoring import Apply, Scorer, apply_all, ensemble_mean, score_column
from driftline.session import materialize
from driftline.sources.events import union_runs

THRESHOLD_METRICS = ("normal_fpr", "fault_fpr", "manipulation_recall", "recon_recall")
STRESS_METRICS = (
    "run_scenario_balanced_false_positive_rate",
    "event_weighted_false_positive_rate",
)
KEYS = ["schema", "seed"]


@dataclass(frozen=True)
class Experiment:
    """Frozen parameters of a transfer run."""

    seeds: tuple[int, ...] = tuple(range(42, 62))
    schemas: tuple[str, ...] = tuple(FEATURE_SCHEMAS)
    validation_fraction: float = 0.3
    max_fpr: float = 0.01
    replicates: int = 2000
    bootstrap_seed: int = 20260817
    quantiles: tuple[float, float] = (0.025, 0.975)
    parallel_fits: int = 4
    labels: tuple[str, ...] = field(default=("normal", "attack"))
    minimum_normals: int = 100
    #: Show the numbers although a contract failed.
    force: bool = False


def prepare(df: DataFrame, schema: str) -> DataFrame:
    """Feature table with the columns evaluation needs beside the features."""
    labelled = df.withColumn("y", is_attack()).withColumn("run_id", F.col("run_id").cast("string"))
    return build_features(labelled, schema, keep=["event_id", "run_id", "scenario", "label", "y"])


def widest(schemas: Sequence[str]) -> str:
    """The schema whose features hold those of all ``schemas``: one feature table then serves every one."""
    columns = {s: {*feature_schema(s).numeric, *feature_schema(s).categorical} for s in schemas}
    most = max(schemas, key=lambda s: len(columns[s]))
    if any(not columns[s] <= columns[most] for s in schemas):
        raise ValueError(f"no schema of {list(schemas)} holds the features of the others")
    return most


def score_schemas(
    main: DataFrame, stress: DataFrame, target: DataFrame, splits: DataFrame, schemas: Sequence[str],
    scorer: Scorer, seeds: Sequence[int], parallel: int = 4,
) -> dict[str, DataFrame]:
    """Scores of all schemas, one column each: ``score_<schema>`` of the validation rows of every seed, and
    ``score_<schema>_<seed>`` of the target and the stress pool.

    Features are written once for all schemas and read by every fit. Splits are by whole runs, so the
    change rate computed on the full pool is the one each side would compute for itself. Fits are
    the only loop, a few submitted at a time. The models of all schemas are applied in one pass, so what
    they compute alike is computed once.
    """
    sources = {"main": main, "stress": stress, "target": target}
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        tables = dict(pool.map(
            lambda item: (item[0], materialize(prepare(item[1], widest(schemas)), f"features-{item[0]}")),
            sources.items(),
        ))

        def placed(seed: int, side: str) -> DataFrame:
            runs = splits.filter((F.col("seed") == seed) & (F.col("side") == side)).select("run_id")
            return tables["main"].join(runs, "run_id")

        def one(seed: int) -> tuple[dict[str, Apply], DataFrame]:
            train = placed(seed, TRAIN)
            models = {schema: scorer(train, feature_schema(schema), seed) for schema in schemas}
            held = apply_all(placed(seed, VALIDATION), models)
            scores = [score_column(schema) for schema in schemas]
            return models, held.select(F.lit(seed).alias("seed"), "event_id", "label", "y", *scores)

        fitted = list(pool.map(one, seeds))
        models = {f"{schema}_{seed}": m[schema] for seed, (m, _) in zip(seeds, fitted) for schema in schemas}
        validation = fitted[0][1]
        for _, part in fitted[1:]:
            validation = validation.unionByName(part)
        wide = {
            "validation": validation,
            "target": apply_all(tables["target"], models),
            "stress": apply_all(tables["stress"], models),
        }
        return dict(pool.map(lambda item: (item[0], materialize(item[1], f"scores-{item[0]}")), wide.items()))


def of_schema(scores: dict[str, DataFrame], schema: str, seeds: Sequence[int]) -> dict[str, DataFrame]:
    """One schema's part of :func:`score_schemas`: validation scores per seed, and wide tables by seed."""
    out = {"validation": scores["validation"].select("seed", "event_id", "label", "y", F.col(score_column(schema)).alias("score"))}
    for name in ("target", "stress"):
        kept = [c for c in scores[name].columns if not c.startswith("score_")]
        own = [F.col(score_column(f"{schema}_{s}")).alias(score_column(s)) for s in seeds]
        out[name] = scores[name].select(*kept, *own)
    return {name: df.withColumn("schema", F.lit(schema)) for name, df in out.items()}


def score_seeds(
    main: DataFrame, stress: DataFrame, target: DataFrame, splits: DataFrame, schema: str,
    scorer: Scorer, seeds: Sequence[int], parallel: int = 4,
) -> dict[str, DataFrame]:
    """Validation scores per seed, and wide score tables of the target and the stress pool."""
    return of_schema(score_schemas(main, stress, target, splits, [schema], scorer, seeds, parallel), schema, seeds)


def evaluate(scores: dict[str, DataFrame], schema: str, exp: Experiment, checks: DataFrame) -> DataFrame:
    """Long result table ``(schema, section, metric, value, lo, hi, min, max, n, ready, n_reasons)``.

    ``checks`` are those of the splits. With the preconditions of the metrics and the contract of the
    results they decide whether numbers are shown: one failed check withholds all of the schema.

    Rows are counted once each: validation rows per score, target and stress rows per cell with the seeds side by
    side, the ensemble per score, run and family. Everything below works on the counts.
    """
    validation = materialize(counted_scores(scores["validation"], [*KEYS, "score", "y"]), "validation-counts")
    target = scores["target"].withColumn("family", scenario_family("scenario"))
    thresholds = materialize(threshold_at_fpr(validation, KEYS, exp.max_fpr), "thresholds")
    ensemble = ensemble_mean(target, exp.seeds)
    ensemble = materialize(counted_scores(ensemble, ["schema", "score", "run_id", "family", "y"]), "ensemble-counts")

    def cells(wide: DataFrame, *by: str) -> DataFrame:
        return materialize(seed_counts(wide, thresholds, exp.seeds, ["schema", *by]), "seed-counts")

    target_cells = cells(target, "family", "run_id", "y")
    stress_cells = cells(scores["stress"], "run_id", "scenario")
    fpr = materialize(validation_fpr(apply_threshold(validation, thresholds, KEYS), KEYS), "validation-fpr")
    parts = [
        (auc(validation, KEYS).withColumnRenamed("auc", "source_validation_auc"), ["source_validation_auc"]),
        (fpr.withColumnRenamed("validation_fpr", "source_validation_fpr"), ["source_validation_fpr"]),
        (threshold_metrics(counted_predictions(target_cells, thresholds, KEYS), KEYS), THRESHOLD_METRICS),
        (stress_fpr(counted_predictions(stress_cells, thresholds, KEYS), KEYS), STRESS_METRICS),
    ]
    per_seed = union_runs(*[long_metrics(wide, KEYS, metrics) for wide, metrics in parts])
    none = F.lit(None).cast("double")
    summary = median_min_max(per_seed, ["schema", "metric"]).select(
        "schema", F.lit("per_seed_summary").alias("section"), "metric", F.col("median").alias("value"),
        none.alias("lo"), none.alias("hi"), "min", "max", "n",
    )
    point = long_metrics(primary_metrics(ensemble, ["schema"]), ["schema"], PRIMARY_METRICS)
    ranges = bootstrap_intervals(ensemble, exp.replicates, exp.bootstrap_seed, exp.quantiles)
    found = materialize(point.join(ranges, "metric"), "primary")
    conditions = metric_preconditions(target_cells, KEYS, FAMILIES)
    results = result_contract(fpr.select("seed", "validation_fpr"), found, exp.seeds, exp.max_fpr)
    reasons = failures(union_checks(*[part.select("passed") for part in (checks, conditions, results)]))
    primary = found.select(
        "schema", F.lit("primary_ensemble").alias("section"), "metric", "value", "lo", "hi",
        none.alias("min"), none.alias("max"), F.lit(len(exp.seeds)).cast("bigint").alias("n"),
    )
    numbers = ["value", "lo", "hi", "min", "max"]
    open_ = F.lit(reasons == 0 or exp.force)
    return summary.unionByName(primary).select(
        "schema", "section", "metric", *[F.when(open_, F.col(c)).alias(c) for c in numbers], "n",
        F.lit(reasons == 0).alias("ready"), F.lit(reasons).cast("bigint").alias("n_reasons"),
    )


def withheld(spark: SparkSession, schema: str, exp: Experiment, reasons: int) -> DataFrame:
    """The result rows of a schema whose numbers may not be made."""
    metrics = [("per_seed_summary", m) for m in ("source_validation_auc", "source_validation_fpr", *THRESHOLD_METRICS, *STRESS_METRICS)]
    metrics += [("primary_ensemble", m) for m in PRIMARY_METRICS]
    rows = [(schema, section, metric, None, None, None, None, None, len(exp.seeds), False, reasons) for section, metric in metrics]
    return spark.createDataFrame(
        rows, "schema string, section string, metric string, value double, lo double, hi double, min double, max double, "
        "n bigint, ready boolean, n_reasons bigint"
    )


def _transfer(
    source: DataFrame, target: DataFrame, schemas: Sequence[str], scorer: Scorer, exp: Experiment, contracts: DataFrame | None
) -> DataFrame:
    """Result rows of ``schemas``: scored together, evaluated a few at a time."""
    broken = failures(contracts) if contracts is not None else 0
    if broken and not exp.force:
        parts = [withheld(source.sparkSession, schema, exp, broken) for schema in schemas]
    else:
        main, stress = main_pool(source, exp.labels), stress_pool(source)
        runs = main.select(F.col("run_id").cast("string").alias("run_id"))
        splits = materialize(split_by_run(runs, list(exp.seeds), exp.validation_fraction), "splits")
        scores = score_schemas(main, stress, target, splits, schemas, scorer, exp.seeds, exp.parallel_fits)
        profile = split_profile(main.withColumn("run_id", F.col("run_id").cast("string")), splits)
        checks = split_contract(profile, exp.labels, minimum_normals=exp.minimum_normals).drop("seed")
        checks = checkpointed(checks if contracts is None else checks.unionByName(contracts))
        with ThreadPoolExecutor(max_workers=exp.parallel_fits) as pool:
            parts = list(pool.map(lambda schema: evaluate(of_schema(scores, schema, exp.seeds), schema, exp, checks), schemas))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def transfer_schema(
    source: DataFrame, target: DataFrame, schema: str, scorer: Scorer, exp: Experiment = Experiment(),
    contracts: DataFrame | None = None,
) -> DataFrame:
    """One feature schema end to end.

    ``contracts`` are checks of the input tables. They are counted before anything is scored: if one failed, nothing
    is fitted and the schema keeps its rows without numbers, unless the experiment is forced.
    """
    return _transfer(source, target, [schema], scorer, exp, contracts)


def transfer_experiment(
    source: DataFrame, target: DataFrame, scorer: Scorer, exp: Experiment = Experiment(), contracts: DataFrame | None = None
) -> DataFrame:
    """All schemas and the row audit as one long table; ``contracts`` guard every schema."""
    out = _transfer(source, target, list(exp.schemas), scorer, exp, contracts)
    audit = pool_audit({
        "raw": source, "main": main_pool(source, exp.labels), "stress": stress_pool(source), "target": target,
    })
    none = F.lit(None).cast("double")
    rows = audit.select(
        F.lit("").alias("schema"), F.concat(F.lit("audit_"), "stage").alias("section"), "metric",
        F.col("value").cast("double").alias("value"), none.alias("lo"), none.alias("hi"), none.alias("min"),
        none.alias("max"), F.lit(1).cast("bigint").alias("n"),
        F.lit(True).alias("ready"), F.lit(0).cast("bigint").alias("n_reasons"),
    )
    return out.unionByName(rows)
