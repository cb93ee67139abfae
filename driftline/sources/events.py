"""Event, campaign and ground-truth scans."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.catalog import EVENT_SCHEMA
from driftline.functions.scalar import epoch_micros, stripped
from driftline.operators.ordered import small_side
from driftline.session import materialize

GROUND_TRUTH_PHASES = T.ArrayType(
    T.StructType(
        [
            T.StructField("phase", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("timestamp", T.StringType()),
        ]
    )
)


def align_columns(df: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Add absent event columns as typed nulls so one plan serves every domain."""
    missing = [f for f in schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def scan_events(
    spark: SparkSession, path: str | list[str], fmt: str = "csv", schema: T.StructType = EVENT_SCHEMA
) -> DataFrame:
    """Read event tables with a declared schema: no inference pass over the data.

    CSV columns are matched by header name, so files may lack optional columns or order them
    differently. Values that do not fit their type fail the read.
    """
    paths = [path] if isinstance(path, str) else path
    if fmt == "csv":
        first = spark.read.option("header", True).csv(paths[0]).columns
        types = {f.name: f.dataType for f in schema.fields}
        declared = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in first])
        reader = spark.read.schema(declared).option("header", True).option("mode", "FAILFAST")
        return align_columns(reader.option("enforceSchema", False).csv(paths), schema)
    return align_columns(spark.read.format(fmt).load(paths), schema)


def scan_campaign(
    spark: SparkSession, paths: list[str], fmt: str = "csv", schema: T.StructType = EVENT_SCHEMA
) -> DataFrame:
    """One table over many per-run files, with the file each row came from.

    Parquet files that differ in optional columns are merged by name in one multi-path scan. CSV files are
    read as lines in one scan: the first line of each file names its columns, and each line is parsed by
    the layout of its file. No job runs per file; only the distinct layouts come to the driver. Values that do not fit
    their type fail the read; quoted line breaks are not supported here (``scan_events`` has them).
    """
    if fmt == "parquet":
        df = spark.read.option("mergeSchema", True).parquet(*paths)
        return align_columns(df.withColumn("file", F.col("_metadata.file_path")), schema)
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    first = F.min_by("value", "_line").alias("_header")
    heads = lines.withColumn("_line", F.monotonically_increasing_id()).where(F.col("_start") == 0).groupBy("file").agg(first)
    heads = small_side(heads)
    layouts = {r["_header"]: next(csv.reader([r["_header"]])) for r in heads.select("_header").distinct().collect()}
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    names = list(dict.fromkeys(sorted({c for cols in layouts.values() for c in cols}, key=lambda c: (list(types).index(c) if c in types else len(types), c))))
    record = None
    for header, columns in sorted(layouts.items()):
        ddl = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns)
        parsed = F.from_csv("value", ddl, {"mode": "FAILFAST"})
        fields = [(parsed[c] if c in columns else F.lit(None).cast(types.get(c, "string"))).alias(c) for c in names]
        here = F.col("_header") == header
        record = F.when(here, F.struct(*fields)) if record is None else record.when(here, F.struct(*fields))
    if record is None:
        return align_columns(spark.createDataFrame([], "file string"), schema)
    rows = lines.join(heads, "file").where((F.col("value") != F.col("_header")) & (F.col("value") != ""))
    return align_columns(rows.select(record.alias("r"), "file").select("r.*", "file"), schema)


def number_events(df: DataFrame) -> DataFrame:
    """Give rows without one a unique ``event_id``, frozen in a written table.

    Generated ids depend on the partitioning, so a recomputed task could hand out others; once
    written they cannot change.
    """
    return materialize(df.withColumn("event_id", F.monotonically_increasing_id()), "numbered-events")


def union_runs(*tables: DataFrame) -> DataFrame:
    """All rows of all run tables, columns matched by name, absent ones null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def ground_truth_from_json(documents: DataFrame, run: str = "run_id", doc: str = "document") -> DataFrame:
    """Ground-truth entries ``(run_id, phase, name, timestamp)`` from one JSON text per run.

    A null ``run_id`` is the run-less document that serves every unmapped run. A run whose list is
    empty or malformed keeps one row of nulls: it is mapped, but has no phases.
    """
    parsed = F.from_json(F.get_json_object(doc, "$.phases"), GROUND_TRUTH_PHASES)
    return documents.select(
        F.col(run).alias("run_id"), F.explode_outer(parsed).alias("entry")
    ).select("run_id", "entry.phase", "entry.name", "entry.timestamp")


def scan_ground_truth(spark: SparkSession, path: str, per_run: bool) -> DataFrame:
    """Read a ground-truth file: one document, or a map of run id to document."""
    text = spark.read.option("wholetext", True).text(path)
    if not per_run:
        return ground_truth_from_json(
            text.select(F.lit(None).cast("string").alias("run_id"), F.col("value").alias("document"))
        )
    runs = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return ground_truth_from_json(text.select(F.explode(runs).alias("run_id", "document")))


def phase_timeline(entries: DataFrame) -> DataFrame:
    """Valid phase starts ``(run_id, t_us, name)``: blank names and bad stamps are dropped."""
    name = stripped(F.coalesce("phase", "name", F.lit("")))
    return entries.select(
        "run_id", epoch_micros("timestamp").alias("t_us"), name.alias("name")
    ).filter((F.col("name") != "") & F.col("t_us").isNotNull())
