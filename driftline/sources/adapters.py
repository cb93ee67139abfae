"""Event tables of both domains, derived from the shared test tables.

``source_events`` plays the source domain (26 integer runs, eight of them fault runs) and
``target_events`` the target domain (12 runs, three per scenario family, phase-level labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.catalog import SITE_A, SITE_B
from driftline.functions.scalar import hash32

FAULT_RUNS = (19, 20, 23, 24, 25, 26, 27, 28)
FAULT_SCENARIOS = ("fault_comm_dropout", "fault_plc_restart", "fault_poll_storm")
BASELINE_START = "2024-01-01T06:00:00+00:00"
ACT_START = "2024-01-08T00:00:00+00:00"
SPREAD_SPLITS = 8
BASELINE_US = 1704088800000000
ACT_US = 1704672000000000


def load(spark: SparkSession, sf_dir: str, table: str, spread_on: str | None = None) -> DataFrame:
    """Read one test table; a scan of only a few splits is spread out by ``spread_on``.

    Spreading matters for a table that sits in one file and is then multiplied by seeds. Fewer
    than ``SPREAD_SPLITS`` splits are about a gigabyte at most, so a large table is never moved.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread_on and df.rdd.getNumPartitions() < min(cores, SPREAD_SPLITS):
        return df.repartition(cores, spread_on)
    return df


def _with_readings(df: DataFrame) -> DataFrame:
    """Counters, protocol fields and rudder readings common to both domains."""
    k = F.col("event_id")
    flow = F.col("event_type") == "flow"
    state = F.element_at(F.array(F.lit("established"), F.lit("new"), F.lit("closed")), (k % 3 + 1).cast("int"))
    function = F.when(~flow, F.when(F.col("label") == "attack", 6.0).otherwise(3.0))
    return (
        df.withColumn("pkts_toserver", F.floor("value").cast("double"))
        .withColumn("pkts_toclient", (k % 50).cast("double"))
        .withColumn("bytes_toserver", F.col("pkts_toserver") * 60)
        .withColumn("bytes_toclient", F.col("pkts_toclient") * 60)
        .withColumn("flow_state", F.when(k % 17 != 0, state))
        .withColumn("modbus_function", function)
        .withColumn("modbus_access", F.when(F.col("modbus_function") == 6, "WRITE").when(F.col("modbus_function") == 3, "READ"))
        .withColumn("rudder_angle", F.when(k % 2 == 0, F.col("value") / 8 - 5))
        .drop("value", "type_in")
    )


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return load(spark, sf_dir, "events", "event_id").select(
        "event_id",
        F.unix_micros(ts).alias("t_us"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.col("event_type").alias("type_in"),
        "value",
    )


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    fault_run = F.col("run_id").isin(list(FAULT_RUNS))
    label = (
        F.when(fault_run & (F.col("type_in") == "error"), "fault")
        .when(~fault_run & (F.col("type_in") == "purchase"), "attack")
        .otherwise("normal")
    )
    kind = (F.floor("value") % 3 + 1).cast("int")
    scenario = F.when(
        F.col("label") == "fault", F.element_at(F.array(*[F.lit(s) for s in FAULT_SCENARIOS]), kind)
    ).otherwise("baseline")
    return _with_readings(
        _base(spark, sf_dir)
        .withColumn("source_dataset", F.lit(SITE_A))
        .withColumn("run_id", (k % 26 + 3).cast("int"))
        .withColumn("event_type", F.when(k % 11 == 0, "alert").when(k % 5 == 0, "flow").otherwise("modbus"))
        .withColumn("label", label)
        .withColumn("scenario", scenario)
    ).withColumn("rpm_command", ((k % 130) * 10).cast("double"))


def target_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    kind = (
        F.when(F.col("type_in") == "error", "fault")
        .when(F.col("type_in") == "purchase", "manipulation")
        .when(F.col("type_in") == "signup", "recon")
        .otherwise("normal")
    )
    phase = (
        F.when(F.col("t_us") < BASELINE_US, "pre-phase")
        .when((F.col("kind") == "normal") | (F.col("t_us") < ACT_US), "baseline")
        .otherwise("act")
    )
    label = F.when(F.col("phase") != "act", "normal").when(F.col("kind") == "fault", "fault").otherwise("attack")
    throttle = (k % 130) / F.lit(100.0)
    return _with_readings(
        _base(spark, sf_dir)
        .withColumn("source_dataset", F.lit(SITE_B))
        .withColumn("kind", kind)
        .withColumn("run_id", F.concat("kind", F.lit("-r0"), (k % 3 + 1).cast("string")))
        .withColumn("scenario", F.concat(F.lit("dom_"), "kind"))
        .withColumn("event_type", F.when(k % 5 == 0, "flow").otherwise("modbus"))
        .withColumn("phase", phase)
        .withColumn("label", label)
        .drop("kind")
    ).withColumns(
        {
            "throttle_command_left": F.when(k % 4 == 1, throttle),
            "throttle_command_right": F.when(k % 4 == 3, throttle),
            "hydraulic_pump_rpm_left": F.when(k % 5 == 2, ((k % 400) * 10).cast("double")),
            "hydraulic_pump_rpm_right": F.when(k % 5 == 3, ((k % 300) * 10).cast("double")),
            "flow_start_us": F.when(F.col("event_type") == "flow", F.col("t_us") - (k % 7200) * 1000000),
        }
    )


def ground_truth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per target run, including entries a reader has to reject."""
    runs = target_events(spark, sf_dir).select("run_id").distinct()

    def entry(key: str, name: str, stamp: str):
        return F.to_json(F.struct(F.lit(name).alias(key), F.lit(stamp).alias("timestamp")))

    common = [
        entry("phase", "baseline", BASELINE_START),
        entry("phase", "  ", "2024-01-02T00:00:00+00:00"),
        entry("name", "broken", "not a stamp"),
    ]
    act = entry("name", "act", ACT_START)
    listed = F.when(F.col("run_id").startswith("normal"), F.concat_ws(",", *common)).otherwise(
        F.concat_ws(",", *common, act)
    )
    return runs.select("run_id", F.concat(F.lit('{"phases": ['), listed, F.lit("]}")).alias("document"))


def hash_votes(df: DataFrame, seed="seed", name: str = "score") -> DataFrame:
    """Replayable stand-in scorer: many ties, and attacks score 40 votes higher."""
    votes = hash32(seed, "event_id") % 141 + F.when(F.col("label") == "attack", 40).otherwise(0)
    return df.withColumn("votes", votes).withColumn(name, F.col("votes") / F.lit(200.0))

