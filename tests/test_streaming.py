"""The streamed alarm load and nested result documents."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import audit, episodes
from driftline.sources import files
from driftline.streaming import alarms

HOUR = 3_600_000_000
SCHEMA = "seed int, run_id string, t_us long, pred int"


def arrivals(seed=5, n=600):
    """Rows in order of time, some of them up to 30 minutes late."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2]), rng.choice("abc"), int(i * 10 * HOUR / n), rng.randint(0, 1)) for i in range(n)]
    return sorted(rows, key=lambda r: r[2] + rng.choice([0, 0, 0, HOUR // 2]))


def load(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_live_load_equals_batch(spark, tmp_path):
    """Files come in four calls, of which each goes on from the one before; late rows count."""
    rows = arrivals()
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cells = alarms.alarm_cells(stream, ["seed"], "1 hour", "40 minutes")
    for i in range(4):
        part = rows[i * 150:(i + 1) * 150]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        alarms.follow(cells, str(tmp_path / "cells"), str(tmp_path / "state"))
        latest = alarms.latest_cells(spark, str(tmp_path / "cells"), ["seed"])
        so_far = spark.createDataFrame(rows[:(i + 1) * 150], SCHEMA)
        assert load(alarms.live_alarm_load(latest, ["seed"])) == load(episodes.alarm_load(so_far, ["seed"]))
    assert latest.count() <= 2 * 3 * 10


def test_rows_without_stamp_and_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    cells = alarms.alarm_cells(stream, ["seed"], "1 hour", "1 hour")
    for part in ([(1, "a", 9 * HOUR, 1), (1, "a", None, 1)], [(1, "a", 10 * HOUR, 0)], [(1, "a", 0, 1), (None, None, 9 * HOUR + 5, 1)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        alarms.follow(cells, str(tmp_path / "cells"), str(tmp_path / "state"))
    got = alarms.latest_cells(spark, str(tmp_path / "cells"), ["seed"]).orderBy("last_us").collect()
    assert [(r.seed, r.run_id, r.alarms, r.last_us) for r in got] == [(1, "a", 1, 9 * HOUR), (None, None, 1, 9 * HOUR + 5), (1, "a", 0, 10 * HOUR)]


def documents(spark):
    rows = [("x", 10, 0.12345678, None), ("x", 9, 2.0, "late"), ("y", 1, None, None)]
    table = spark.createDataFrame(rows, "experiment string, seed int, rate double, note string")
    return files.nested_members(table, ["experiment"], "seed", "seeds")


def test_document_round_trip(spark, tmp_path):
    path = str(tmp_path / "result")
    meant = documents(spark)
    files.write_documents(meant, path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines == [
        '{"experiment":"x","seeds":{"9":{"rate":2.0,"note":"late"},"10":{"rate":0.123457,"note":null}}}',
        '{"experiment":"y","seeds":{"1":{"rate":null,"note":null}}}',
    ]
    back = files.scan_documents(spark, path, meant.schema)
    text = lambda df: df.select("experiment", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("d"))
    nodes = [audit.flatten_variant(text(df), "experiment", "d") for df in (meant, back)]
    assert audit.result_diff(*nodes, ["experiment", "path"]).count() == 0
    changed = back.withColumn("seeds", F.map_filter("seeds", lambda k, v: k != "9"))
    other = audit.flatten_variant(text(changed), "experiment", "d")
    assert audit.result_diff(nodes[0], other, ["experiment", "path"]).count() == 4


def test_broken_document_fails(spark, tmp_path):
    path = tmp_path / "broken"
    path.write_text('{"experiment": "x", "seeds": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_documents(spark, str(path), documents(spark).schema).collect()
