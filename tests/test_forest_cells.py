"""Forests over counted cells: equal rows are counted once, results do not depend on how rows lie, bins tell values apart."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftline.catalog import FeatureSchema
from driftline.operators import forest
from driftline.plans import scoring

FLOW = FeatureSchema("flow", False, ())


def flows(spark, rows, times=1):
    """Rows whose label follows packets and state, with noise; ``times`` equal copies of each."""
    k = F.col("id") % rows
    noise = F.pmod(F.xxhash64(k), F.lit(10)) < 2
    high = (k % 50 >= 30) & (F.col("flow_state") != "closed")
    return (
        spark.range(rows * times)
        .withColumn("flow_state", F.element_at(F.array(*map(F.lit, ("closed", "new", "established"))), (k % 3 + 1).cast("int")))
        .select(
            F.col("id").alias("event_id"), "flow_state", (k % 50).cast("double").alias("pkts_toserver"), (k % 7).cast("double").alias("pkts_toclient"),
            ((k % 50) * 60.0).alias("bytes_toserver"), F.pmod(F.xxhash64(k, F.lit(1)), F.lit(1000)).cast("double").alias("bytes_toclient"),
            (high != noise).cast("int").alias("y"),
        )
    )


def scores(spark, table, cells, seed=1, trees=20, depth=5):
    out = forest.score(cells.encoding, {"score": forest.grow(cells, seed, trees, depth)}, table)
    return {r[0]: r[1] for r in out.select("event_id", "score").collect()}


def test_copies_are_cells_of_their_number(spark):
    encoding = forest.Encoding.learn(flows(spark, 3000), FLOW)
    one, many = (forest.Cells.of(flows(spark, 3000, times), encoding) for times in (1, 40))
    assert one.table.count() == many.table.count() <= 3000
    assert many.table.agg(F.sum("n")).first()[0] == 120_000


def test_trees_are_grown_from_cells(spark):
    """What trees are grown from has a row per cell, however many copies there are."""
    table = flows(spark, 2000, 50)
    cells = forest.Cells.count(table, FLOW)
    assert cells.table.count() <= 2000 < table.count()
    assert forest.grow(cells, 1, 3, 2).depth == 2


def test_draws_of_a_cell_have_the_law_of_drawing_its_rows(spark):
    cells = forest.Cells.count(flows(spark, 300, 20), FLOW)
    grown = forest.Trees.stumps(5, 200, 0.5)
    nodes = np.arange(200)
    features = grown.candidates(nodes, cells.encoding.width)
    sums = cells.table.groupBy("block").applyInPandas(forest._sums(grown, nodes, features, cells.encoding.names()), forest.SUMS)
    drawn = [r[0] for r in sums.filter("slot = 0").groupBy("node").agg(F.sum("w")).select("sum(w)").collect()]
    assert len(drawn) == 200
    assert abs(np.mean(drawn) - 6000) < 4 * (6000 / 200) ** 0.5
    assert 0.7 * 6000 < np.var(drawn) < 1.4 * 6000


def test_best_cut_is_that_of_all_candidates(spark):
    rows = [(0, s, b, (3 * b + s) % 5 + 1, ((3 * b + s) % 5 + 1) if (b > 2 + s) else (b + s) % 2) for s in range(3) for b in range(6)]
    totals = {s: [sum(r[i] for r in rows if r[1] == s) for i in (3, 4)] for s in range(3)}

    def gini(w, wy):
        return 2 * wy * (w - wy) / w

    def gain(s, b):
        w, wy = (sum(r[i] for r in rows if r[1] == s and r[2] <= b) for i in (3, 4))
        return gini(*totals[s]) - gini(w, wy) - gini(totals[s][0] - w, totals[s][1] - wy)

    want = max(((s, b) for s in range(3) for b in range(5)), key=lambda c: (round(gain(*c), 9), -c[0], -c[1]))
    # Sums of several blocks are added up.
    got = forest.best_cuts(spark.createDataFrame([*rows, *rows], forest.SUMS)).first()
    assert (got["slot"], got["bin"]) == want


def test_forest_depends_neither_on_partitions_nor_on_order(spark):
    table = flows(spark, 1500, 2)
    encoding = forest.Encoding.learn(table, FLOW)
    plain = scores(spark, table, forest.Cells.of(table, encoding))
    mixed = table.repartition(13, F.xxhash64("event_id")).sortWithinPartitions(F.desc("event_id"))
    assert plain == scores(spark, table, forest.Cells.of(mixed, encoding))
    assert plain != scores(spark, table, forest.Cells.of(table, encoding), seed=2)


def test_scores_are_close_to_those_of_the_library(spark):
    table = flows(spark, 3000, 3)
    ours = scores(spark, table, forest.Cells.count(table, FLOW), trees=60)
    rf = RandomForestClassifier(labelCol="y", numTrees=60, maxDepth=5, seed=1, featureSubsetStrategy="sqrt")
    model = Pipeline(stages=[*scoring.encoder_stages(FLOW), rf]).fit(table)
    theirs = {r[0]: r[1] for r in model.transform(table).select("event_id", vector_to_array("probability")[1]).collect()}
    gap = np.array([ours[k] - theirs[k] for k in theirs])
    assert len(ours) == len(theirs) == 9000 and abs(gap.mean()) < 0.01 and np.abs(gap).mean() < 0.05


@pytest.mark.parametrize("values", [[0.0, 1.0], list(range(31)), [0.0, 0.5, 1e6]])
def test_few_values_are_bins_of_their_own_also_rare_ones(spark, values):
    often = spark.range(20_000).select(F.lit(float(values[0])).alias("x"))
    rare = spark.createDataFrame([(float(v),) for v in values[1:]], "x double")
    assert forest.cut_points(often.unionByName(rare), ["x"])["x"] == sorted(map(float, values))


def test_many_values_fill_all_bins_beside_a_frequent_one(spark):
    table = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("double").alias("x"))
    cuts = forest.cut_points(table, ["x"])["x"]
    assert len(cuts) == forest.BINS - 1 and cuts[-1] > 15_000


def test_equal_rows_in_a_partition_have_the_score_they_have_alone(spark):
    table = flows(spark, 700, 6)
    cells = forest.Cells.count(table, FLOW)
    grown = {f"s{seed}": forest.grow(cells, seed, 5, 4) for seed in (1, 2)}
    together, apart = (
        sorted(map(tuple, forest.score(cells.encoding, grown, t).select("event_id", "s1", "s2").collect()))
        for t in (table.coalesce(1), table.repartition(40, "event_id"))
    )
    assert together == apart and len(together) == 4200


def test_one_class_and_unseen_categories(spark):
    table = flows(spark, 200).withColumn("y", F.lit(1))
    cells = forest.Cells.count(table, FLOW)
    assert set(scores(spark, table.withColumn("flow_state", F.lit("other")), cells).values()) == {1.0}
    with pytest.raises(ValueError, match="at least one"):
        forest.Cells.count(table.limit(0), FLOW)
