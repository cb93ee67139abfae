"""Ranking, threshold and bootstrap operators against literal values and numpy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions.scalar import next_double
from driftline.operators import bootstrap, ordered, ranking, thresholds
from driftline.operators.ordered import Split, carry_forward, exact_quantiles, previous_row, running_sum

FEW_RUNS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
HOT = Split(limit=5)


def brute_auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    y, s = np.asarray(y), np.asarray(s, float)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    gt = (s[pos][:, None] > s[neg]) + 0.5 * (s[pos][:, None] == s[neg])
    return float((gt * w[pos][:, None] * w[neg]).sum() / (w[pos].sum() * w[neg].sum()))


def brute_primary(y, s, fam):
    y, s, fam = np.asarray(y), np.asarray(s), np.asarray(fam, object)
    w = np.array([1.0 / (fam == f).sum() for f in fam])
    out = {"event_weighted_auc": brute_auc(y, s), "scenario_balanced_auc": brute_auc(y, s, w)}
    for f in ("manipulation", "recon"):
        m = (fam == "normal") | ((fam == f) & (y == 1))
        out[f"{f}_vs_normal_auc"] = brute_auc(y[m], s[m])
    return out


def brute_threshold(s, y, budget):
    neg = np.sort(np.asarray([a for a, b in zip(s, y) if b == 0], float))
    if not len(neg):
        return 0.5
    for c in np.unique(neg):
        if (neg >= c).mean() <= budget:
            return float(c)
    return float(np.nextafter(neg.max(), np.inf))


def test_separable_case_scores_one(spark):
    rows = list(zip(["normal", "normal", "fault", "fault", "manipulation", "recon"], [0, 0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.8, 0.9]))
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, family string, y int, score double")
    row = ranking.primary_metrics(df, ["k"]).first()
    assert [row[m] for m in ranking.PRIMARY_METRICS] == [1.0] * 4


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 0, 0.2), (2, 1, 0.3), (2, 0, 0.3)], "k int, y int, score double")
    assert {r.k: r.auc for r in ranking.auc(df, ["k"]).collect()} == {1: None, 2: 0.5}


@FEW_RUNS
@given(st.integers(0, 10_000))
def test_primary_metrics_match_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    n = 80
    fam = rng.choice(["normal", "fault", "manipulation", "recon"], n)
    fam[:4] = ["normal", "fault", "manipulation", "recon"]
    y = ((fam == "manipulation") | (fam == "recon") | (rng.random(n) < 0.1)).astype(int)
    y[:4] = [0, 0, 1, 1]
    s = rng.integers(0, 12, n) / 8.0
    df = spark.createDataFrame([(0, str(f), int(a), float(b)) for f, a, b in zip(fam, y, s)], "k int, family string, y int, score double")
    want = brute_primary(y, s, fam)
    for split in (Split(), HOT):
        got = ranking.primary_metrics(df.repartition(5), ["k"], split).first()
        for m, v in want.items():
            assert got[m] == pytest.approx(v, abs=1e-12)


@FEW_RUNS
@given(st.integers(0, 10_000), st.sampled_from([0.0, 0.01, 0.1, 0.3]))
def test_threshold_matches_search(spark, seed, budget):
    rng = np.random.default_rng(seed)
    s, y = rng.integers(0, 30, 60) / 16.0, rng.integers(0, 2, 60)
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, s)], "k int, y int, score double")
    for split in (Split(), HOT):
        assert thresholds.threshold_at_fpr(df, ["k"], budget, split).first()["threshold"] == brute_threshold(s, y, budget)


def test_tied_scores_keep_the_budget(spark):
    rows = [(0, 0, 0.0)] * 90 + [(0, 0, 0.4)] * 10
    df = spark.createDataFrame(rows, "k int, y int, score double")
    thr = thresholds.threshold_at_fpr(df, ["k"], 0.01)
    assert thr.first()["threshold"] == math.nextafter(0.4, math.inf)
    assert thresholds.validation_fpr(thresholds.apply_threshold(df, thr, ["k"]), ["k"]).first()["validation_fpr"] == 0.0


def test_no_negatives_gives_one_half(spark):
    df = spark.createDataFrame([(0, 1, 0.9)], "k int, y int, score double")
    assert thresholds.threshold_at_fpr(df, ["k"], 0.01).first()["threshold"] == 0.5


def test_next_double(spark):
    values = [0.0, 1.0, 0.4, 0.7, 1e-300, 123456.789, -0.3, 2.0**52, 1 - 2**-53, 5e-324]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", next_double(F.col("v")).alias("n"))
    for r in rows.collect():
        assert r.n == math.nextafter(r.v, math.inf)


@pytest.mark.parametrize("split", [Split(), HOT])
def test_ordered_operators(spark, split):
    """One key holds most rows; every operator must agree with a plain loop."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 4 else f"cold{i % 3}", int(rng.integers(0, 25)), i, float(rng.integers(0, 9)), None if i % 3 else f"p{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v double, p string")
    lists: dict = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        lists.setdefault(r[0], []).append(r)
    want_prev, want_carry = {}, {}
    for items in lists.values():
        last_p = None
        for i, r in enumerate(items):
            want_prev[r[2]] = (items[i - 1][3], items[i - 1][1]) if i else None
            last_p = r[4] if r[4] is not None else last_p
            want_carry[r[2]] = last_p
    got = previous_row(df, ["k"], "t", ["id"], ["v", "t"], split).collect()
    assert {r.id: tuple(r.previous) if r.previous else None for r in got} == want_prev
    got = carry_forward(df, ["k"], "t", ["id"], F.col("p"), "p", split).collect()
    assert {r.id: r.p for r in got} == want_carry

    counts = df.groupBy("k", "t").agg(F.count("*").alias("n"))
    expected = {(k, t): sum(1 for r in items if r[1] < t) for k, items in lists.items() for t in {r[1] for r in items}}
    sums = running_sum(counts, ["k"], "t", ["n"], split=split).collect()
    assert {(r.k, r.t): r.n_before for r in sums} == expected
    assert all(r.n_total == len(lists[r.k]) for r in sums)
    q = {r.k: (r.a, r.b, r.n) for r in exact_quantiles(df, ["k"], "v", {"a": 0.025, "b": 0.77}, split).collect()}
    for k, items in lists.items():
        v = [r[3] for r in items]
        assert q[k] == (pytest.approx(np.quantile(v, 0.025)), pytest.approx(np.quantile(v, 0.77)), len(v))


def test_hot_key_is_cut_into_even_segments(spark):
    """A key with a third of all rows never meets in one window partition."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.col("id").alias("t")
    )
    split = Split(limit=500)
    parts = ordered._segments(df, ["k"], ["t"], split).groupBy("k", "_segment").count()
    assert parts.filter("k = 'hot'").count() >= 20
    assert parts.agg(F.max("count")).first()[0] < 1.6 * split.limit
    assert ordered._segments(df, ["k"], ["t"], Split(limit=10_001)) is None


def test_a_tiny_limit_does_not_make_a_file_per_few_rows(spark, monkeypatch):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.lit(1).alias("one"))
    found = lambda: ordered._segments(df, ["k"], ["t"], Split(limit=2)).groupBy("_segment").count().count()
    assert found() <= ordered.MOST_SEGMENTS
    got = {r.t: r.one_before for r in running_sum(df, ["k"], "t", ["one"], split=Split(limit=2)).collect()}
    assert got == {i: i for i in range(4000)}
    monkeypatch.setattr(ordered, "ROW_LIMIT", 10)  # a task never takes more than this
    assert found() >= 390


def test_one_stamp_is_cut_too(spark):
    """Equal stamps are ordered by the tie and spread over segments; null keys keep their rows."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").alias("k"), F.lit(5).alias("t"), "id", F.lit(1).alias("one")
    )
    split = Split(limit=100)
    parts = ordered._segments(df, ["k"], ["t", "id"], split).groupBy("_segment").count()
    assert parts.agg(F.max("count")).first()[0] < 2 * split.limit
    for cut in (Split(), split):
        got = {r.id: (r.one_before, r.one_total) for r in running_sum(df, ["k"], "t", ["one"], tie=["id"], split=cut).collect()}
        assert got == {i: (sum(j % 3 > 0 for j in range(i)), 2000) if i % 3 else (i // 3, 1000) for i in range(3000)}
        back = {r.id: r.previous and r.previous.id for r in ordered.previous_row(df, ["k"], "t", ["id"], ["id"], cut).collect()}
        assert back == {i: (i - 3 if i % 3 == 0 else i - (2 if i % 3 == 1 else 1)) if i > 2 or i == 2 else None for i in range(3000)}


@pytest.mark.parametrize("segment_cells", [10**9, 40])
def test_bootstrap_matches_literal_resampling(spark, segment_cells):
    rng = np.random.default_rng(11)
    rows = []
    for fam in ("normal", "fault", "manipulation", "recon"):
        for r in range(3):
            for _ in range(int(rng.integers(4, 9))):
                y = int(fam in ("manipulation", "recon") and rng.random() < 0.8)
                rows.append((f"{fam}{r}", fam, y, float(rng.integers(0, 15) / 8 + y * 0.5)))
    # One run that occurs under two families: it is drawn for both.
    rows += [("normal0", "recon", 1, 0.75), ("normal0", "recon", 0, 0.25)]
    df = spark.createDataFrame(rows, "run_id string, family string, y int, score double")
    m = {}
    for r in bootstrap.resample_multiplicity(df, 20, 5).collect():
        m.setdefault(r.replicate, {})[r.run_id] = r.m
    assert all(sum(v.values()) == 3 + 3 + 3 + 4 for v in m.values())
    got = bootstrap.replicate_metrics(df, 20, 5, segment_cells=segment_cells).collect()
    assert len(got) == 20
    for row in got:
        sample = [x for x in rows for _ in range(m[row.replicate].get(x[0], 0))]
        want = brute_primary([x[2] for x in sample], [x[3] for x in sample], [x[1] for x in sample])
        for k, v in want.items():
            assert row[k] == pytest.approx(v, abs=1e-12)


def test_episode_interval_is_ordered(spark):
    hits = spark.createDataFrame([(42, "recon", 5, 3)], "seed int, family string, n_episodes long, n_hit long")
    r = bootstrap.episode_recall_ci(hits, ["seed", "family"], 500).first()
    assert 0 <= r.lo <= r["mean"] <= r.hi <= 1
    assert r["mean"] == 0.6


def test_episode_interval_follows_the_binomial(spark):
    """Against the exact quantiles of the distribution; ten million episodes cost no more rows than its spread."""
    rows = [(1, "a", 10, 3), (1, "b", 1, 1), (1, "c", 7, 0), (1, "d", 10_000_000, 2_500_000), (1, "e", 0, 0), (2, "a", 400, 399)]
    hits = spark.createDataFrame(rows, "seed int, family string, n_episodes long, n_hit long")
    got = {(r.seed, r.family): r for r in bootstrap.episode_recall_ci(hits, ["seed", "family"], 4000).collect()}
    assert (got[1, "b"].lo, got[1, "b"].hi, got[1, "c"].lo, got[1, "c"].hi) == (1.0, 1.0, 0.0, 0.0)
    assert got[1, "e"].lo is None and got[1, "e"].n_episodes == 0
    assert (got[1, "a"].lo, got[1, "a"].hi) == (0.0, 0.6)
    sd = (0.25 * 0.75 / 1e7) ** 0.5
    assert abs(got[1, "d"].lo - (0.25 - 1.96 * sd)) < 0.15 * sd and abs(got[1, "d"].hi - (0.25 + 1.96 * sd)) < 0.15 * sd
    assert got[2, "a"].hi == 1.0 and 0.99 <= got[2, "a"].lo < 1.0


def test_long_strata_are_drawn_in_blocks(spark):
    n = bootstrap.DRAW_BLOCK * 2 + 7
    strata = spark.createDataFrame([("f", n)], "family string, n long")
    d = bootstrap._draws(strata, 2, "n")
    assert d.count() == 2 * n
    assert d.select("replicate", "draw").distinct().count() == 2 * n
    assert d.agg(F.max("draw")).first()[0] == n - 1


def test_seed_summary_and_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 8.0), ("b", None)], "metric string, value double")
    r = thresholds.median_min_max(df.filter("metric = 'a'"), ["metric"]).first()
    assert (r["median"], r["min"], r["max"], r.n, r.finite) == (3.0, 1.0, 8.0, 3, True)
    assert [x.metric for x in thresholds.mean_min_max(df, ["metric"]).collect()] == ["a"]
