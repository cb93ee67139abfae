"""Counted tables stand for their rows; a transfer scores all schemas in one pass."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import bootstrap, contracts, ranking, thresholds
from driftline.plans import scoring, transfer

FAMILIES = ("normal", "fault", "manipulation", "recon")
SEEDS = (1, 2)


@pytest.fixture(scope="module")
def wide(spark):
    odd = {5: None, 6: float("nan"), 7: float("inf")}
    rows = [
        ("s", FAMILIES[i % 4], f"r{i % 9}", f"x_{FAMILIES[i % 4]}", int(i % 4 > 1 and i % 3 > 0), odd.get(i, i % 11 / 11), i % 7 / 7)
        for i in range(300)
    ]
    return spark.createDataFrame(rows, "schema string, family string, run_id string, scenario string, y int, score_1 double, score_2 double")


@pytest.fixture(scope="module")
def cuts(spark):
    return spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.4)], "schema string, seed int, threshold double")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_seeds_side_by_side_equal_rows_per_seed(wide, cuts):
    keys = ["schema", "seed"]
    rows = thresholds.apply_threshold(scoring.by_seed(wide, SEEDS), cuts, keys)
    cells = thresholds.seed_counts(wide, cuts, SEEDS, ["schema", "family", "run_id", "scenario", "y"])
    counted = thresholds.counted_predictions(cells, cuts, keys)
    same(thresholds.threshold_metrics(counted, keys), thresholds.threshold_metrics(rows, keys))
    same(thresholds.stress_fpr(counted, keys), thresholds.stress_fpr(rows, keys))
    conditions = contracts.metric_preconditions(cells, keys, FAMILIES)
    same(conditions, contracts.metric_preconditions(scoring.by_seed(wide, SEEDS), keys, FAMILIES))
    assert conditions.filter("not passed").count() == 1


def test_counted_scores_equal_rows(wide):
    rows = wide.withColumn("score", F.col("score_2"))
    counted = ranking.counted_scores(rows, ["schema", "score", "run_id", "family", "y"])
    assert counted.count() < rows.count()
    key = ["schema"]
    same(ranking.auc(counted, key), ranking.auc(rows, key))
    same(ranking.primary_metrics(counted, key), ranking.primary_metrics(rows, key))
    same(thresholds.threshold_at_fpr(counted, key, 0.2), thresholds.threshold_at_fpr(rows, key, 0.2))
    same(bootstrap.bootstrap_intervals(counted, 50, 7), bootstrap.bootstrap_intervals(rows, 50, 7))


def test_features_and_scores_are_written_once_for_all_schemas(spark, monkeypatch):
    source = spark.range(400).select(
        F.col("id").alias("event_id"), (F.col("id") % 8).cast("string").alias("run_id"), F.lit("baseline").alias("scenario"),
        F.when(F.col("id") % 16 > 7, "attack").otherwise("normal").alias("label"), F.lit("flow").alias("event_type"),
        (F.col("id") % 5).cast("double").alias("pkts_toserver"), F.col("id").alias("t_us"), F.lit("site_a").alias("source_dataset"),
    )
    written = []
    kept = transfer.materialize
    monkeypatch.setattr(transfer, "materialize", lambda df, name: written.append(name) or kept(df, name))
    splits = spark.createDataFrame([(s, str(r), "train" if r % 2 else "validation") for s in SEEDS for r in range(8)], "seed int, run_id string, side string")
    schemas = ["flow", "protocol", "physical_proxy"]
    scores = transfer.score_schemas(source, source, source, splits, schemas, scoring.rule_scorer(), SEEDS)
    assert sorted(written) == ["features-main", "features-stress", "features-target", "scores-stress", "scores-target", "scores-validation"]
    for schema in schemas:
        part = transfer.of_schema(scores, schema, SEEDS)
        own = transfer.prepare(source, schema).select("event_id", (F.col("pkts_toserver") > 0).cast("double").alias("score_1"))
        same(part["target"].select("event_id", "score_1"), own)
        assert part["validation"].groupBy("seed").count().collect() == [(1, 200), (2, 200)] or part["validation"].count() == 400
