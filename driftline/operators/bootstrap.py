"""Run-stratified and episode bootstraps without materialising resampled rows.

A resample repeats every event of a drawn run, so a replicate is described by one integer per
run: how often it was drawn. Metrics of a replicate are the ordinary metrics with each count
multiplied by that integer. Events are therefore counted once per (score, run, family); the
score range is cut into segments, the replicates into blocks; each task computes the pair counts of
one block for one segment, and segment totals are chained afterwards. Draw counts are sent to a task
once per run, not with every counted row. Work grows with the counted rows, not with pairs of runs,
and no resampled copy exists.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalar import hash32
from driftline.operators.ordered import Split, checkpointed, running_sum
from driftline.operators.ranking import ALL_FAMILIES, PRIMARY_METRICS, counts_of, metric_columns

DRAW_BLOCK = 4096
#: Standard deviations of a binomial count that are tabulated on either side of its mean.
SPREADS = 12
SEGMENT_CELLS = 50_000
#: Draw counts (runs times replicates) that one task holds.
BLOCK_DRAWS = 4_000_000


def _draws(strata: DataFrame, replicates: int, size: str) -> DataFrame:
    """One row per (stratum, replicate, draw); long strata are expanded block by block.

    The few rows of strata, replicates and blocks are dealt to all partitions before the draws are
    made. The number is stated, since a runtime that merges small partitions would undo it.
    """
    blocks = strata.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    last = F.floor((F.col(size) - 1) / DRAW_BLOCK)
    blocks = blocks.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    tasks = int(strata.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(tasks, "replicate", "_block")
    start = F.col("_block") * DRAW_BLOCK
    stop = F.least(start + DRAW_BLOCK, F.col(size).cast("bigint")) - 1
    return blocks.withColumn("draw", F.explode(F.sequence(start, stop))).drop("_block")


def resample_multiplicity(
    run_families: DataFrame, replicates: int, seed: int, split: Split = Split()
) -> DataFrame:
    """``(replicate, run_id, m)``: draws with replacement, as many per family as it has runs.

    Replayable: draw ``j`` of replicate ``b`` in a stratum takes run ``hash(seed|b|stratum|j) mod n``.
    A run listed under two families adds up its draws from both. Runs never drawn have no row.
    """
    runs = run_families.select("family", "run_id").distinct().withColumns(
        {"_order": hash32("run_id"), "_one": F.lit(1)}
    )
    ranked = running_sum(runs, ["family"], "_order", ["_one"], tie=["run_id"], split=split).select(
        "family", "run_id", F.col("_one_before").alias("rank"), F.col("_one_total").alias("n")
    )
    ranked = checkpointed(ranked)
    strata = ranked.groupBy("family").agg(F.max("n").alias("n"))
    draws = _draws(strata, replicates, "n")
    picks = draws.select(
        "family", "replicate", (hash32(F.lit(seed), "replicate", "family", "draw") % F.col("n")).alias("rank")
    )
    counted = picks.groupBy("family", "rank", "replicate").agg(F.count(F.lit(1)).alias("m"))
    return (
        counted.join(ranked, ["family", "rank"])
        .groupBy("replicate", "run_id")
        .agg(F.sum("m").alias("m"))
    )


def _draw_lists(multiplicity: DataFrame, width: int) -> DataFrame:
    """Per (run, block of ``width`` replicates) the replicates that draw it and how often."""
    block = F.floor(F.col("replicate") / width).cast("int").alias("block")
    return multiplicity.groupBy("run_id", block).agg(
        F.collect_list("replicate").alias("at"), F.collect_list(F.col("m").cast("int")).alias("times")
    )


def _segment_pairs(families: Sequence[str], all_replicates: int, width: int):
    """Pair counts of one segment for one block of replicates; rows of equal score share a segment."""
    index = {f: i for i, f in enumerate(families)}
    k = len(families)
    max_cells = 4_000_000

    def compute(key: tuple, frame: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        segment, block = key
        first_replicate = block * width
        replicates = min(width, all_replicates - first_replicate)
        runs = pd.Index(drawn["run_id"])
        # The last row stands for runs that no replicate of the block draws.
        draw_counts = np.zeros((len(runs) + 1, replicates))
        for i, (at, times) in enumerate(zip(drawn["at"], drawn["times"])):
            draw_counts[i, np.asarray(at) - first_replicate] = times
        frame = frame.sort_values("score", kind="stable")
        run = runs.get_indexer(frame["run_id"])
        scores = frame["score"].to_numpy()
        family = frame["family"].map(index).to_numpy()
        pos, neg = frame["pos"].to_numpy(float), frame["neg"].to_numpy(float)
        below = np.zeros((k, replicates))
        pos_all = np.zeros((k, replicates))
        twice = np.zeros((k, k, replicates))
        starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        bounds = np.r_[starts, len(scores)]
        step = max(1, max_cells // (k * replicates))
        for first in range(0, len(starts), step):
            last = min(first + step, len(starts))
            lo, hi = bounds[first], bounds[last]
            slot = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
            p = np.zeros((last - first, k, replicates))
            n = np.zeros((last - first, k, replicates))
            draws = draw_counts[run[lo:hi]]
            np.add.at(p, (slot, family[lo:hi]), pos[lo:hi, None] * draws)
            np.add.at(n, (slot, family[lo:hi]), neg[lo:hi, None] * draws)
            ahead = np.cumsum(n, axis=0)
            twice += np.einsum("spb,snb->pnb", p, 2.0 * (below + ahead - n) + n, optimize=True)
            below += ahead[-1]
            pos_all += p.sum(axis=0)
        out = {"segment": segment, "replicate": np.arange(replicates) + first_replicate}
        for f, i in index.items():
            out[f"pos_{f}"], out[f"neg_{f}"] = pos_all[i], below[i]
            for g, j in index.items():
                out[f"twice_{f}_{g}"] = twice[i, j]
        return pd.DataFrame(out)

    return compute


def _with_segment(cells: DataFrame, segments: int) -> DataFrame:
    """Cut the distinct scores into about equal parts; the bucketizer searches the cuts in O(log n)."""
    if segments == 1:
        return cells.withColumn("segment", F.lit(0.0))
    fractions = [i / segments for i in range(1, segments)]
    edges = (
        cells.select("score").distinct()
        .agg(F.percentile_approx("score", fractions, 4 * segments).alias("edges"))
        .first()["edges"]
    )
    cuts = [float("-inf"), *sorted(set(edges)), float("inf")]
    return Bucketizer(splits=cuts, inputCol="score", outputCol="segment").transform(cells)


def replicate_metrics(
    scored: DataFrame,
    replicates: int,
    seed: int,
    families: Sequence[str] = ALL_FAMILIES,
    segment_cells: int = SEGMENT_CELLS,
) -> DataFrame:
    """The four primary metrics of every replicate, family weights recomputed inside each.

    A task holds one score segment of about ``segment_cells`` (score, run, family) counts and the draw
    counts of one block of replicates. Only one number per cut passes through the driver.
    """
    cells = checkpointed(
        scored.groupBy("score", "run_id", "family").agg(
            F.sum((F.col("y") == 1).cast("bigint") * counts_of(scored)).alias("pos"),
            F.sum((F.col("y") == 0).cast("bigint") * counts_of(scored)).alias("neg"),
        )
    )
    multiplicity = checkpointed(resample_multiplicity(cells, replicates, seed))
    size = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("run_id").alias("runs")).first()
    width = max(1, min(replicates, BLOCK_DRAWS // max(1, size["runs"])))
    blocks = ceil(replicates / width)
    segments = max(1, ceil(size["cells"] / segment_cells))
    located = _with_segment(cells, segments).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lists = _draw_lists(multiplicity, width).withColumn(
        "segment", F.explode(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: s.cast("double")))
    )
    names = [f"{s}_{f}" for f in families for s in ("pos", "neg")]
    pairs = [(f, g) for f in families for g in families]
    schema = T.StructType(
        [T.StructField("segment", T.DoubleType()), T.StructField("replicate", T.IntegerType())]
        + [T.StructField(n, T.DoubleType()) for n in [*names, *[f"twice_{f}_{g}" for f, g in pairs]]]
    )
    pairs_of = _segment_pairs(families, replicates, width)

    def compute(key: tuple, frame: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        return pairs_of(key, frame, drawn) if len(frame) else pd.DataFrame(columns=schema.names)

    parts = located.groupBy("segment", "block").cogroup(lists.groupBy("segment", "block")).applyInPandas(compute, schema)

    earlier = Window.partitionBy("replicate").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    chained = parts.select(
        "*", *[F.coalesce(F.sum(f"neg_{f}").over(earlier), F.lit(0.0)).alias(f"_below_{f}") for f in families]
    )
    totals = chained.groupBy("replicate").agg(
        *[F.sum(n).alias(n) for n in names],
        *[
            F.sum(F.col(f"twice_{f}_{g}") + 2.0 * F.col(f"pos_{f}") * F.col(f"_below_{g}")).alias(f"twice_{f}_{g}")
            for f, g in pairs
        ],
    )
    return totals.select("replicate", *[c.alias(m) for m, c in metric_columns(families).items()])


def bootstrap_intervals(
    scored: DataFrame,
    replicates: int = 2000,
    seed: int = 20260817,
    quantiles: tuple[float, float] = (0.025, 0.975),
    segment_cells: int = SEGMENT_CELLS,
) -> DataFrame:
    """``(metric, lo, hi)`` over replicates of a family-stratified run bootstrap."""
    values = replicate_metrics(scored, replicates, seed, segment_cells=segment_cells).unpivot(
        ["replicate"], list(PRIMARY_METRICS), "metric", "value"
    )
    # ``replicates`` values per metric: a fixed bound, so exact percentiles in one task are fine.
    lo, hi = (F.percentile("value", q) for q in quantiles)
    return values.groupBy("metric").agg(lo.alias("lo"), hi.alias("hi"))


def episode_recall_ci(
    hits: DataFrame,
    keys: Sequence[str],
    replicates: int = 2000,
    alpha: float = 0.05,
    seed_column: str = "seed",
) -> DataFrame:
    """Mean and percentile interval of resampled episode recall, from hit counts alone.

    ``hits`` has one row per key with ``n_episodes`` and ``n_hit``. Episodes are exchangeable, so a resample's
    hits follow the binomial distribution of (episodes, share hit). A replicate is one hash, inverted at that
    distribution: no draw per episode is made. ``SPREADS`` standard deviations of it are tabulated, beyond which
    less than 1e-30 lies, so work grows with the root of the number of episodes at most.
    The hash takes the value of ``seed_column`` and the other keys. A key without episodes has no interval.
    """
    others = [k for k in keys if k != seed_column]
    n, hit = F.col("n_episodes").cast("double"), F.col("n_hit").cast("double")
    wide = F.ceil(SPREADS * F.sqrt(hit * (n - hit) / n) + SPREADS)
    first = F.greatest(F.col("n_hit") - wide, F.lit(0)).cast("bigint")
    last = F.least(F.col("n_hit") + wide, F.col("n_episodes")).cast("bigint")
    table = hits.where("n_episodes > 0").select(
        *keys, "n_episodes", "n_hit", first.alias("_first"), F.explode(F.sequence(first, last)).alias("k")
    )
    certain = (F.col("n_hit") == 0) | (F.col("n_hit") == F.col("n_episodes"))
    table = table.where(~certain | (F.col("k") == F.col("n_hit")))
    # Each count's weight by that of the count before it; the largest weight is brought to one.
    odds = F.log(n - F.col("k") + 1) - F.log(F.col("k").cast("double")) + F.log(hit) - F.log(n - hit)
    step = F.when(certain | (F.col("k") == F.col("_first")), F.lit(0.0)).otherwise(odds)
    ordered = Window.partitionBy(*keys).orderBy("k")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*keys)
    weighted = table.withColumn("_log", F.sum(step).over(upto)).withColumn("_w", F.exp(F.col("_log") - F.max("_log").over(group)))
    below = weighted.select(*keys, "k", F.coalesce(F.sum("_w").over(ordered.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("_w").over(group), F.lit(0.0)).alias("at"))
    draws = hits.where("n_episodes > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    at = (hash32(seed_column, *others, "replicate") + F.lit(0.5)) / F.lit(float(1 << 32))
    # A replicate's count is the last one whose lower bound lies at or below its hash.
    both = below.select(*keys, "at", "k", F.lit(0).alias("drawn")).unionByName(
        draws.select(*keys, at.alias("at"), F.lit(None).cast("bigint").alias("k"), F.lit(1).alias("drawn"))
    )
    found = F.last("k", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("at", "drawn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = both.withColumn("_found", found).where("drawn = 1")
    spread = counts.groupBy(*keys).agg(F.percentile("_found", alpha / 2).alias("_lo"), F.percentile("_found", 1 - alpha / 2).alias("_hi"))
    point = hits.select(*keys, "n_episodes", F.try_divide("n_hit", "n_episodes").alias("mean"))
    return point.join(spread, list(keys), "left").select(
        *keys, "mean", F.try_divide("_lo", "n_episodes").alias("lo"), F.try_divide("_hi", "n_episodes").alias("hi"), "n_episodes"
    )
