"""Row pools, set comparisons and the simple per-run and per-family aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.catalog import ACCEPTED_TYPES
from driftline.functions.scalar import is_attack, scenario_family
from driftline.operators.ordered import checkpointed, small_side


POOL_COLUMNS = ("run_id", "scenario", "label", "event_type")


def counted(df: DataFrame) -> DataFrame:
    """Rows per run, scenario, label and type, as ``n_rows``, checkpointed.

    The pools are defined by these columns, so every pool of the counted table is the count of the pool: audits
    and contracts of all pools then come from one pass over the events.
    """
    return checkpointed(df.groupBy(*POOL_COLUMNS).agg(F.count(F.lit(1)).alias("n_rows")))


def rows_of(df: DataFrame) -> Column:
    """Number of events in an aggregate, of an event table or of a counted one."""
    return F.coalesce(F.sum("n_rows"), F.lit(0)) if "n_rows" in df.columns else F.count(F.lit(1))


def accepted_events(df: DataFrame, types: Sequence[str] = ACCEPTED_TYPES) -> DataFrame:
    return df.filter(F.col("event_type").isin(list(types)))


def contaminated_runs(accepted: DataFrame, label: str = "fault") -> DataFrame:
    return accepted.filter(F.col("label") == label).select("run_id").distinct()


def main_pool(
    df: DataFrame, labels: Sequence[str] = ("normal", "attack"), types: Sequence[str] = ACCEPTED_TYPES
) -> DataFrame:
    """Accepted rows of runs without any fault row; whole contaminated runs are dropped."""
    accepted = accepted_events(df, types)
    faulty = small_side(contaminated_runs(accepted))
    return accepted.filter(F.col("label").isin(list(labels))).join(faulty, "run_id", "left_anti")


def stress_pool(
    df: DataFrame, runs: Sequence | None = None, label: str = "fault", types: Sequence[str] = ACCEPTED_TYPES
) -> DataFrame:
    """Accepted fault rows, of the listed runs or of every contaminated run."""
    rows = accepted_events(df, types).filter(F.col("label") == label)
    return rows if runs is None else rows.filter(F.col("run_id").isin(list(runs)))


def with_family(df: DataFrame) -> DataFrame:
    return df.withColumn("family", scenario_family("scenario"))


def mask_counts(df: DataFrame) -> DataFrame:
    """Benign and attack rows per family: the kind comes from the scenario, the moment from the label."""
    attack = is_attack()
    return with_family(df).groupBy("family").agg(
        F.sum(1 - attack).alias("benign_rows"), F.sum(attack).alias("attack_rows")
    )


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns as rows ``(field, value)``, from one pass."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return df.groupBy(*columns).agg(F.lit(1)).select(pairs.alias("p")).select("p.*").distinct()


def cell_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("run_id", "scenario").alias("cells"))


def family_counts(df: DataFrame) -> DataFrame:
    return with_family(df).groupBy("family").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("run_id").alias("n_runs")
    )


def labels_per_run(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id").agg(F.count_distinct("label").alias("n_labels"))


def family_repeats(df: DataFrame, minimum: int = 3) -> DataFrame:
    runs = with_family(df).groupBy("family").agg(F.count_distinct("run_id").alias("n_runs"))
    return runs.withColumn("thin", F.col("n_runs") < minimum)


def run_duration(df: DataFrame, minimum_seconds: float = 60.0) -> DataFrame:
    """Observed span per run; a run without any valid time is not flagged."""
    span = df.groupBy("run_id").agg(
        ((F.max("t_us") - F.min("t_us")) / F.lit(1e6)).alias("duration_sec")
    )
    return span.withColumn(
        "short", F.coalesce(F.col("duration_sec") < F.lit(minimum_seconds), F.lit(False))
    )


def scenario_map(df: DataFrame) -> DataFrame:
    return with_family(df.select("scenario").distinct())


def run_name_family(df: DataFrame) -> DataFrame:
    """Distinct runs per family read off the run name (text before ``-r``)."""
    family = F.split("run_id", "-r", 2)[0]
    return df.select("run_id").distinct().groupBy(family.alias("family")).agg(
        F.count(F.lit(1)).alias("n_runs")
    )


def run_scenario_pivot(df: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """Rows per run and listed fault scenario, plus the run's normal rows."""
    return df.groupBy("run_id").agg(
        *[F.sum((F.col("scenario") == s).cast("int")).alias(s) for s in scenarios],
        F.sum((F.col("label") == "normal").cast("int")).alias("normal_rows"),
    )


def pool_audit(pools: dict[str, DataFrame]) -> DataFrame:
    """Rows, runs and run-scenario cells after each filter as ``(stage, metric, value)``."""
    out = None
    for stage, df in pools.items():
        # Several distinct counts over raw rows would copy each row; count cells first.
        cells = df.groupBy("run_id", "scenario").agg(rows_of(df).alias("n"))
        one = cells.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count_distinct("run_id").alias("n_runs"),
            F.count(F.lit(1)).alias("n_cells"),
        )
        part = one.select(
            F.lit(stage).alias("stage"),
            F.explode(F.create_map(*[x for m in one.columns for x in (F.lit(m), F.col(m))])).alias("metric", "value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def set_difference(expected: DataFrame, actual: DataFrame, value: str = "value") -> DataFrame:
    """Values on one side only, with the side they are on."""
    e = expected.select(value).distinct().withColumn("_e", F.lit(1))
    a = actual.select(value).distinct().withColumn("_a", F.lit(1))
    side = F.when(F.col("_a").isNull(), "missing").otherwise("unexpected")
    return (
        e.join(a, value, "full_outer")
        .filter(F.col("_e").isNull() | F.col("_a").isNull())
        .select(value, side.alias("side"))
    )
