"""Clustering by approximations against plain k-means, and its awkward cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, vec string"


def plain(rows, centroids=16, rounds=3):
    """Every distance worked out, in whole numbers."""
    ids = [r[0] for r in rows]
    x = np.array([[int(np.floor(64 * v)) for v in r[1]] for r in rows], dtype=np.int64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), ids[i] or 0, list(x[i])))
    c = x[order[:centroids]].copy()
    for step in range(rounds + 1):
        apart = ((x[:, None, :] - c) ** 2).sum(axis=2)
        at = apart.argmin(axis=1)
        if step < rounds:
            for k in range(len(c)):
                if (at == k).any():
                    c[k] = np.floor_divide(x[at == k].sum(axis=0), (at == k).sum())
    distance = apart.min(axis=1)
    shas = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted(
        (str(i), int(k), int(d), int(distance[at == k].sum()), int(distance.sum()), shas[k]) for i, k, d in zip(ids, at, distance)
    )


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def vectors(n, seed=3, spread=0.2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, 64))
    return [(i, (middles[i % 7] + spread * rng.normal(size=64)).tolist(), "mine", "mine") for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_as_plain_k_means(spark, spread):
    rows = vectors(400, spread=spread)
    assert got(clusters.cluster(spark.createDataFrame(rows, SCHEMA)).rows) == plain(rows)


def test_intervals_hold_and_settle_rows(spark):
    unit = np.random.default_rng(4).normal(scale=0.125, size=(3000, 64)).tolist()
    rows = spark.createDataFrame([(i, v, "x", "x") for i, v in enumerate(unit)], SCHEMA)
    assert max(clusters.cluster(rows).fetched) < 0.25
    kept = clusters.kept(rows)
    cells = clusters.fit_cells(kept)
    x = np.array([r["vec"] for r in kept.collect()])
    at = cells.encode(x)
    dims = np.arange(64)
    assert (cells.starts[dims, at] <= x).all() and (x <= cells.ends[dims, at]).all()
    middles = x[:5]
    least, most = cells.tables(middles)
    less = ((x[:, None, :] - middles) ** 2).sum(axis=2) - ((x - middles.sum(axis=0) // 5) ** 2).sum(axis=1)[:, None]
    assert (sum(least[d][at[:, d]] for d in dims) <= less).all() and (less <= sum(most[d][at[:, d]] for d in dims)).all()


def test_ties_repeated_rows_and_ids(spark):
    """Equal vectors tie between equal centroids: the smaller number wins; one vector holds most rows."""
    base = vectors(20)
    rows = base + [(100 + i, base[0][1], "mine", "mine") for i in range(60)] + [base[1], (5, base[9][1], "mine", "mine")]
    assert got(clusters.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5)).rows) == plain(rows)


def test_rows_that_take_no_part(spark):
    good = vectors(30)
    bad = [
        (200, None, "x", "x"), (201, [], "x", "x"), (202, [0.5] * 63, "x", "x"), (203, [0.5] * 65, "x", "x"), (204, [0.5] * 63 + [None], "x", "x"),
        (205, [0.5] * 63 + [float("nan")], "x", "x"), (206, [0.5] * 63 + [float("-inf")], "x", "x"), (207, [0.5] * 63 + [1e300], "x", "x"),
    ]
    nameless = [(None, [0.25] * 64, "x", "x"), (300, [-0.001] * 64, "x", "x"), (301, [0.0] * 64, "x", "x"), (302, [2e6] * 64, "x", "x")]
    assert got(clusters.cluster(spark.createDataFrame(good + bad + nameless, SCHEMA)).rows) == plain(good + nameless)


def test_few_rows_and_none(spark):
    few = vectors(3)
    assert got(clusters.cluster(spark.createDataFrame(few, SCHEMA)).rows) == plain(few)
    out = clusters.cluster(spark.createDataFrame([], SCHEMA)).rows
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_inertia_beyond_64_bits_is_null(spark):
    far = [(i, [(-1) ** i * 2.0e6] * 64, "x", "x") for i in range(40)]
    out = clusters.cluster(spark.createDataFrame(far, SCHEMA), centroids=1, rounds=0).rows
    assert out.where("inertia is not null").count() == 0 and out.where("distance is null").count() == 0


def test_vector_goes_to_python_only_where_needed(spark):
    rows = clusters.kept(spark.createDataFrame(vectors(50), SCHEMA))
    middles, cells = clusters.first_centroids(rows), clusters.fit_cells(rows)
    file = clusters.approximated(rows, cells)
    plan = clusters.assign(file, cells, middles)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Exchange" not in plan
    assert clusters.assign(file, cells, middles).where(F.col("found") >= 0).count() > 0
