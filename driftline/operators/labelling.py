"""Phase-derived labels, phase back-dating and flows that span a phase boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import is_write, safe_double
from driftline.operators.episodes import asof_phase
from driftline.operators.ordered import Split, previous_row, small_side

# The label each campaign phase stands for.
PHASE_LABELS = {
    "authorized_baseline": "normal",
    "baseline": "normal",
    "healthy_baseline": "normal",
    "unauthorized_manipulation": "attack",
    "recon_burst": "attack",
    "recon_complete": "attack",
    "dual_hydraulic_pump_loss": "fault",
}
DEFAULT_LABEL = "normal"


def phase_labels(
    events: DataFrame, timeline: DataFrame, label_map: DataFrame, split: Split = Split()
) -> DataFrame:
    """Label each event by its phase; rows before the first phase, or unmapped, are normal.

    ``label_map`` has ``name`` and ``phase_label``, and may add ``run_id`` for run-specific phases.
    """
    keyed = asof_phase(events, timeline, split=split)
    keys = [c for c in ("run_id", "name") if c in label_map.columns]
    named = keyed.withColumnRenamed("phase_name", "name")
    out = named.join(small_side(label_map), keys, "left").withColumnRenamed("name", "phase_name")
    return out.withColumn("phase_label", F.coalesce("phase_label", F.lit(DEFAULT_LABEL)))


def phase_row_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("run_id", "phase_name", "phase_label").agg(F.count(F.lit(1)).alias("n_rows"))


def run_label(labelled: DataFrame, label: str = "phase_label") -> DataFrame:
    """The run's non-normal label (normal if it has none) and whether labels vary inside the run."""
    marked = F.max(F.when(F.col(label) != DEFAULT_LABEL, F.col(label)))
    return labelled.groupBy("run_id").agg(
        F.coalesce(marked, F.lit(DEFAULT_LABEL)).alias("run_label"),
        (F.count_distinct(label) > 1).alias("label_is_phase_level"),
    )


def phase_backdate(events: DataFrame, timeline: DataFrame, setpoints: DataFrame, value: str) -> DataFrame:
    """Move a phase start back to the first write that carries the phase's setpoint.

    Looked for after the previous phase start and up to the recorded marker. ``setpoints`` is
    ``(name, setpoint)``; reads never match. Anchors tell which starts moved.
    """
    marks = previous_row(timeline, ["run_id"], "t_us", ["name"], ["t_us"]).select(
        "run_id", "name", F.col("t_us").alias("marker_us"), F.col("previous.t_us").alias("previous_us")
    )
    wanted = marks.join(small_side(setpoints), "name").select("run_id", "name", "marker_us", "previous_us", "setpoint")
    writes = events.filter(is_write() & safe_double(value).isNotNull()).select(
        F.col("run_id").alias("_run"), F.col("t_us").alias("_t"), safe_double(value).alias("_value")
    )
    inside = (
        (F.col("_run") == F.col("run_id"))
        & (F.col("_value") == F.col("setpoint"))
        & (F.col("_t") <= F.col("marker_us"))
        & (F.col("previous_us").isNull() | (F.col("_t") > F.col("previous_us")))
    )
    first = (
        writes.join(small_side(wanted), inside)
        .groupBy("run_id", "name", "marker_us")
        .agg(F.min("_t").alias("write_us"))
    )
    return marks.join(first, ["run_id", "name", "marker_us"], "left").select(
        "run_id",
        "name",
        "marker_us",
        F.coalesce("write_us", "marker_us").alias("start_us"),
        F.when(F.col("write_us").isNotNull(), "setpoint").otherwise("marker").alias("anchor"),
        F.coalesce(F.col("write_us") < F.col("marker_us"), F.lit(False)).alias("backdated"),
    )


def flow_boundary_span(
    events: DataFrame, timeline: DataFrame, start: str = "flow_start_us", split: Split = Split()
) -> DataFrame:
    """Flow rows per run and how many of them started before a phase boundary they ended after.

    Flows are stamped at their end. One as-of lookup at the end time is enough: the latest phase
    start by then lies after the flow's start exactly when some boundary was spanned.
    """
    flows = events.filter(F.col("event_type") == "flow").select("run_id", "t_us", start, "event_id")
    attached = asof_phase(flows, timeline, split=split)
    spans = F.coalesce(F.col("phase_start_us") > F.col(start), F.lit(False)).cast("int")
    return attached.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("flow_rows"), F.sum(spans).alias("flow_rows_spanning_boundary")
    )
