"""Phase attachment and the episode, latency and alarm metrics built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ordered import (
    BROADCAST_ROWS,
    Split,
    carry_forward,
    checkpointed,
    exact_quantiles,
    small_side,
)

PRE_PHASE = "pre-phase"
BASIS_PHASES, BASIS_COLUMN, BASIS_RUN = "ground_truth_phase", "phase_column", "run_id"
# Above this many phases in one run, comparing each event with each phase costs more than sorting.
DENSE_PHASES = 64


def run_timeline(runs: DataFrame, entries: DataFrame, phases: DataFrame) -> DataFrame:
    """Phase starts of each run: its own if it is mapped, else the run-less ones.

    ``entries`` are the raw ground-truth rows (they tell which runs are mapped at all), ``phases``
    the valid ones. Unmapped runs meet the run-less phases through an equi-join on a document key.
    """
    mapped = entries.filter(F.col("run_id").isNotNull()).select("run_id").distinct()
    keyed = runs.select("run_id").distinct().join(
        mapped.withColumn("_mapped", F.lit(True)), "run_id", "left"
    )
    document = F.struct(
        F.coalesce("_mapped", F.lit(False)).alias("own"), F.when(F.col("_mapped"), F.col("run_id")).alias("run")
    )
    source = F.struct(F.col("run_id").isNotNull().alias("own"), F.col("run_id").alias("run"))
    listed = phases.select(source.alias("_document"), "t_us", "name")
    return (
        keyed.withColumn("_document", document)
        .join(listed.withColumnRenamed("_document", "_listed"), F.col("_document").eqNullSafe(F.col("_listed")))
        .select("run_id", "t_us", "name")
    )


def phase_starts(timeline: DataFrame) -> DataFrame:
    """``(run_id, start_us, name)``; of equal starts in a run the greatest name stays."""
    starts = timeline.groupBy("run_id", F.col("t_us").alias("start_us"))
    return starts.agg(F.max("name").alias("name"))


def asof_phase(
    events: DataFrame,
    timeline: DataFrame,
    time: str = "t_us",
    dense: int = DENSE_PHASES,
    split: Split = Split(),
) -> DataFrame:
    """Add ``phase_name`` and ``phase_start_us``: the last phase of the run begun by the event's time.

    Timelines are short as a rule. If no run has more than ``dense`` phases the events are joined
    to the run's intervals, which needs no shuffle of the events when the timeline is small. Dense
    timelines are merged with the events and carried forward in time order instead. Both ways give the
    same rows: an event without time is before all phases, and events without run have the phases
    without run.
    """
    starts = checkpointed(phase_starts(timeline))
    size = starts.groupBy("run_id").count().agg(
        F.max("count").alias("densest"), F.sum("count").alias("n_phases")
    ).first()
    if (size["densest"] or 0) <= dense:
        following = F.lead("start_us").over(Window.partitionBy("run_id").orderBy("start_us"))
        intervals = starts.withColumn("end_us", following)
        small = (size["n_phases"] or 0) <= BROADCAST_ROWS
        lookup = (F.broadcast(intervals) if small else intervals).alias("p")
        inside = (
            F.col("e.run_id").eqNullSafe(F.col("p.run_id"))
            & (F.col("p.start_us") <= F.col(f"e.{time}"))
            & (F.col("p.end_us").isNull() | (F.col(f"e.{time}") < F.col("p.end_us")))
        )
        joined = events.alias("e").join(lookup, inside, "left")
        out = joined.select("e.*", F.col("p.name").alias("phase_name"), F.col("p.start_us").alias("phase_start_us"))
    else:
        marks = starts.select(
            "run_id",
            F.col("start_us").alias("_t"),
            F.lit(0).alias("_is_event"),
            F.struct(F.col("name").alias("name"), F.col("start_us").alias("start")).alias("_phase"),
            F.lit(None).cast(events.select(F.struct("*")).schema[0].dataType).alias("_event"),
        )
        rows = events.select(
            "run_id",
            F.col(time).alias("_t"),
            F.lit(1).alias("_is_event"),
            F.lit(None).cast("struct<name: string, start: bigint>").alias("_phase"),
            F.struct("*").alias("_event"),
        )
        merged = carry_forward(
            marks.unionByName(rows), ["run_id"], "_t", ["_is_event"], F.col("_phase"), "_last", split
        ).filter(F.col("_is_event") == 1)
        out = merged.select(
            "_event.*", F.col("_last.name").alias("phase_name"), F.col("_last.start").alias("phase_start_us")
        )
    return out.withColumn("phase_name", F.coalesce("phase_name", F.lit(PRE_PHASE)))


def episode_basis(
    masked: DataFrame, timeline: DataFrame, keys: Sequence[str] = (), has_phase_column: bool = False
) -> DataFrame:
    """Whether every run of the masked rows has phases; otherwise the whole set falls back.

    One row per key with ``basis``. A single run without phases moves all runs of the key to the
    ``phase`` column, or to whole runs when there is none.
    """
    covered = timeline.select("run_id").distinct().withColumn("_covered", F.lit(True))
    runs = masked.select(*keys, "run_id").distinct().join(covered, "run_id", "left")
    fallback = BASIS_COLUMN if has_phase_column else BASIS_RUN
    resolved = F.bool_and(F.coalesce("_covered", F.lit(False)))
    basis = F.when(resolved, BASIS_PHASES).otherwise(fallback)
    return runs.groupBy(*keys).agg(basis.alias("basis"))


def with_episode(
    masked: DataFrame,
    timeline: DataFrame,
    keys: Sequence[str],
    phase_column: str | None = None,
    split: Split = Split(),
) -> DataFrame:
    """Add ``basis`` and ``episode`` (the phase part of the key, empty on a whole-run basis).

    Neither depends on scores: call it on one row per event, before seeds fan out.

    The episode of a row is the pair (run, episode): a phase name that recurs in a run is one episode.
    """
    basis = episode_basis(masked, timeline, keys, phase_column is not None)
    attached = asof_phase(masked, timeline, split=split).join(small_side(basis), list(keys))
    fallback = F.col(phase_column).cast("string") if phase_column else F.lit(None).cast("string")
    episode = F.when(F.col("basis") == BASIS_PHASES, F.col("phase_name")).otherwise(fallback)
    return attached.withColumn("episode", F.coalesce(episode, F.lit(""))).drop("phase_name", "phase_start_us")


def episode_summary(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per episode: hit flag, first event time, first alarm time. Map-side combined."""
    return predicted.groupBy(*keys, "run_id", "episode").agg(
        F.max("pred").alias("hit"),
        F.min("t_us").alias("first_us"),
        F.min(F.when(F.col("pred") == 1, F.col("t_us"))).alias("alarm_us"),
    )


def episode_hits(episodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.sum("hit").alias("n_hit"),
        F.avg("hit").alias("recall_episode"),
    )


def detection_latency(episodes: DataFrame, keys: Sequence[str], split: Split = Split()) -> DataFrame:
    """Seconds from an episode's first attack event to its first alarm.

    An episode without alarm, or without any valid time, is missed; one whose alarms all lack a
    time is neither detected nor missed.
    """
    missed = (F.col("hit") == 0) | F.col("first_us").isNull()
    latency = (F.col("alarm_us") - F.col("first_us")) / F.lit(1e6)
    rows = episodes.withColumn("latency", F.when(~missed, latency))
    sums = rows.groupBy(*keys).agg(
        F.avg("latency").alias("mean_sec"),
        F.max("latency").alias("max_sec"),
        F.count("latency").alias("n_detected"),
        F.count(F.when(missed, 1)).alias("n_missed"),
    )
    median = exact_quantiles(rows, list(keys), "latency", {"median_sec": 0.5}, split).drop("n")
    return sums.join(median, list(keys), "left").select(
        *keys, "median_sec", "mean_sec", "max_sec", "n_detected", "n_missed"
    )


def alarm_load(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alarms per run and per observed hour over all rows, not only attack phases."""
    per_run = predicted.groupBy(*keys, "run_id").agg(
        F.sum("pred").alias("_alarms"), (F.max("t_us") - F.min("t_us")).alias("_span")
    )
    return load_of_runs(per_run, keys)


def load_of_runs(per_run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alarm load from the alarms and the span of each run."""
    hours = F.coalesce(F.sum("_span"), F.lit(0)) / F.lit(3.6e9)
    observed = F.when(hours > 0, hours)
    return per_run.groupBy(*keys).agg(
        F.avg("_alarms").alias("alarms_per_run_mean"),
        F.max("_alarms").alias("alarms_per_run_max"),
        F.count(F.lit(1)).alias("n_runs"),
        (F.sum("_alarms") / observed).alias("alarms_per_hour"),
        observed.alias("observed_hours"),
    )
