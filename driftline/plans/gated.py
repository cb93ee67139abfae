"""Contract-gated evaluation: numbers appear only for seeds whose contracts hold, or when forced."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.catalog import feature_schema
from driftline.functions.scalar import is_attack, scenario_family
from driftline.operators.bootstrap import episode_recall_ci
from driftline.operators.contracts import (
    class_composition,
    gate,
    readiness_checks,
    refusal_mode,
    split_checks,
)
from driftline.operators.episodes import (
    alarm_load,
    detection_latency,
    episode_hits,
    episode_summary,
    run_timeline,
    with_episode,
)
from driftline.operators.features import build_features, with_time
from driftline.operators.splits import (
    TRAIN,
    VALIDATION,
    row_split_profile,
    split_profile,
    split_by_run,
    split_with_basis,
)
from driftline.operators.thresholds import (
    apply_threshold,
    event_rates,
    mean_min_max,
    threshold_at_fpr,
)
from driftline.plans.scoring import KEEP, Scorer, apply_all, by_seed, rule_scorer
from driftline.session import materialize
from driftline.sources.events import phase_timeline

ATTACKS = ("manipulation", "recon")
SUMMARY_METRICS = ("fpr_normal", "fpr_fault", "recall_event_manipulation", "recall_event_recon")
EPISODE_METRICS = ("recall_episode_manipulation", "recall_episode_recon")


def contracts(
    train: DataFrame, test: DataFrame, entries: DataFrame | None, seeds: Sequence[int],
    max_fpr: float, validation_fraction: float, force: bool, inputs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(splits or split rows profile, modes)`` for the seed list."""
    runs = train.select("run_id").distinct().limit(2).count()
    if runs >= 2:
        splits = materialize(split_by_run(train, list(seeds), validation_fraction), "splits")
        profile = split_profile(train, splits)
    else:
        splits = None
        profile = row_split_profile(split_with_basis(train, list(seeds), validation_fraction))
    profile = materialize(profile, "profile")
    own = split_checks(profile, max_fpr).unionByName(class_composition(profile, test, seeds))
    general = readiness_checks(test, entries)
    general = general if inputs is None else general.unionByName(inputs)
    return splits, refusal_mode(general, own, seeds, force)


def _scored(
    train: DataFrame, test: DataFrame, splits: DataFrame | None, schema: str, scorer: Scorer,
    seeds: Sequence[int], validation_fraction: float,
) -> tuple[DataFrame, DataFrame]:
    """Validation rows with a score per seed, and test rows with one score column per seed."""
    fs = feature_schema(schema)

    def features(df: DataFrame) -> DataFrame:
        labelled = df.withColumn("y", is_attack())
        return build_features(labelled, schema, [c for c in KEEP if c in labelled.columns])

    if splits is None:
        rows = split_with_basis(train, list(seeds), validation_fraction)
        sides = materialize(rows.select("seed", "event_id", "side"), "row-splits")
        on = "event_id"
    else:
        sides, on = splits, "run_id"
    with ThreadPoolExecutor(max_workers=2) as pool:
        train_f, test_f = pool.map(
            lambda item: materialize(features(item[1]), f"gated-{schema}-{item[0]}"),
            (("train", train), ("test", test)),
        )
    models, validation = {}, None
    for seed in seeds:
        placed = train_f.join(sides.filter(F.col("seed") == seed).select(on, "side"), on)
        models[seed] = scorer(placed.filter(F.col("side") == TRAIN).drop("side"), fs, seed)
        held = models[seed](placed.filter(F.col("side") == VALIDATION).drop("side"), "score")
        part = held.select(F.lit(seed).alias("seed"), "y", "score")
        validation = part if validation is None else validation.unionByName(part)
    return validation, apply_all(test_f, models)


def gated_eval(
    train: DataFrame,
    test: DataFrame,
    schema: str,
    entries: DataFrame | None,
    scorer: Scorer | None = None,
    seeds: Sequence[int] = (42,),
    max_fpr: float = 0.01,
    validation_fraction: float = 0.3,
    force: bool = False,
    replicates: int = 2000,
    inputs: DataFrame | None = None,
) -> DataFrame:
    """One wide row per seed: mode, threshold, event rates, episode recall, latency, alarm load.

    Refused seeds keep their row with null metrics. ``inputs`` are checks of the input tables against their
    manifests; a failed one refuses every seed.
    """
    scorer = scorer or rule_scorer()
    train, test = with_time(train), with_time(test)
    splits, modes = contracts(train, test, entries, seeds, max_fpr, validation_fraction, force, inputs)
    validation, tested = _scored(train, test, splits, schema, scorer, seeds, validation_fraction)
    with ThreadPoolExecutor(max_workers=2) as pool:
        thresholds, scored = pool.map(
            lambda make: make(),
            (
                lambda: materialize(threshold_at_fpr(validation, ["seed"], max_fpr), "thresholds"),
                lambda: materialize(tested, "scored"),
            ),
        )
    # One row per event is stored; the seeds fan out inside each aggregate below.
    phase = ["phase"] if "phase" in test.columns else []
    predicted = apply_threshold(by_seed(scored, seeds), thresholds, ["seed"]).select(
        "seed", "event_id", "run_id", scenario_family("scenario").alias("family"), "y", "pred", "t_us", *phase
    )
    wide = thresholds.join(event_rates(predicted, ["seed"]), "seed", "left")
    wide = wide.join(alarm_load(predicted, ["seed"]), "seed", "left")

    events = scored.withColumn("family", scenario_family("scenario"))
    masked = events.filter(F.col("family").isin(list(ATTACKS)) & (F.col("y") == 1))
    keys = ["seed", "family"]
    if entries is None:
        timeline = masked.select("run_id", "t_us", F.lit("").alias("name")).limit(0)
    else:
        timeline = run_timeline(test, entries, phase_timeline(entries))
    timeline = materialize(timeline, "timeline")
    keyed = with_episode(masked, timeline, ["family"], phase[0] if phase else None)
    keyed = apply_threshold(by_seed(keyed, seeds), thresholds, ["seed"])
    episodes = materialize(episode_summary(keyed, [*keys, "basis"]), "episodes")
    hits = episode_hits(episodes, [*keys, "basis"])
    recall = episode_recall_ci(hits, keys, replicates)
    latency = detection_latency(episodes, keys)
    per_attack = recall.join(latency, keys, "left").join(hits.select(*keys, "basis"), keys)
    for attack in ATTACKS:
        part = per_attack.filter(F.col("family") == attack).select(
            "seed",
            F.col("mean").alias(f"recall_episode_{attack}"),
            F.col("lo").alias(f"recall_episode_{attack}_lo"),
            F.col("hi").alias(f"recall_episode_{attack}_hi"),
            F.col("n_episodes").alias(f"n_episodes_{attack}"),
            F.col("basis").alias(f"episode_basis_{attack}"),
            F.col("median_sec").alias(f"latency_{attack}_median_sec"),
            F.col("n_detected").alias(f"latency_{attack}_n_detected"),
            F.col("n_missed").alias(f"latency_{attack}_n_missed"),
        )
        wide = wide.join(part, "seed", "left")
    return gate(wide, modes)


def multiseed_summary(per_seed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, min and max of each headline metric over seeds, per ``keys``, nulls skipped.

    Per-seed values are rounded before they are summarised: event rates to four digits, episode
    recall to three.
    """
    values = per_seed.select(
        *keys, "seed",
        *[F.round(m, 4).alias(m) for m in SUMMARY_METRICS],
        *[F.round(m, 3).alias(m) for m in EPISODE_METRICS],
    ).unpivot([*keys, "seed"], [*SUMMARY_METRICS, *EPISODE_METRICS], "metric", "value")
    digits = F.when(F.col("metric").isin(list(EPISODE_METRICS)), 3).otherwise(4)
    spread = mean_min_max(values, [*keys, "metric"])
    return spread.select(
        *keys, "metric", *[F.when(digits == 3, F.round(c, 3)).otherwise(F.round(c, 4)).alias(c) for c in ("mean", "min", "max")]
    )


def seeds_state(per_seed: DataFrame) -> DataFrame:
    """Ready only if every seed is; the mode is that of the first seed."""
    return per_seed.agg(
        F.bool_and("ready").alias("ready"), F.min_by("mode", "seed").alias("mode"), F.count(F.lit(1)).alias("n_seeds")
    )
