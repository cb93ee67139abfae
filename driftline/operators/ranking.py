"""Ranking metrics from one concordance table.

Scored events are first counted per distinct score and family (map-side combined, so a hot key
never moves as rows). One prefix sum over the distinct scores then gives, for each pair of
families, twice the number of correctly ordered (positive, negative) pairs with ties as one half.
All four metrics are ratios of those integers, so they do not depend on row order.

Scored events may come counted: a row with ``n_rows`` stands for that many equal ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.catalog import FAMILIES, OTHER
from driftline.operators.ordered import Split, checkpointed, running_sum

ALL_FAMILIES = (*FAMILIES, OTHER)
PRIMARY_METRICS = (
    "event_weighted_auc",
    "scenario_balanced_auc",
    "manipulation_vs_normal_auc",
    "recon_vs_normal_auc",
)
# Pair counts reach 2 * P * N, beyond 64 bits for large tables: 18 x 18 digits fit in 38.
COUNT = "decimal(18,0)"


def counts_of(scored: DataFrame) -> Column:
    """Events that a row stands for: ``n_rows`` of a counted table, else one."""
    return F.col("n_rows") if "n_rows" in scored.columns else F.lit(1).cast("bigint")


def counted_scores(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of equal ``columns`` as one row with ``n_rows``."""
    return scored.groupBy(*columns).agg(F.sum(counts_of(scored)).alias("n_rows"))


def auc(
    scored: DataFrame, keys: Sequence[str], weight: str | None = None, split: Split = Split()
) -> DataFrame:
    """Area under the ROC curve of ``score`` for ``y`` per key; null unless both classes occur."""
    w = F.col(weight).cast("double") if weight else counts_of(scored)
    zero = F.lit(0.0) if weight else F.lit(0).cast("bigint")
    counts = scored.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("y") == 1, w).otherwise(zero)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, w).otherwise(zero)).alias("neg"),
    )
    ranked = running_sum(checkpointed(counts), list(keys), "score", ["neg"], split=split)
    pos, neg, before = F.col("pos"), F.col("neg"), F.col("neg_before")
    if not weight:
        pos, neg, before = pos.cast(COUNT), neg.cast(COUNT), before.cast(COUNT)
    sums = ranked.groupBy(*keys).agg(
        F.sum(pos * (before * 2 + neg).cast("double" if weight else COUNT)).cast("double").alias("twice"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
    )
    area = F.try_divide(F.col("twice"), F.lit(2.0) * F.col("p") * F.col("n"))
    return sums.select(*keys, area.alias("auc"))


def concordance(
    scored: DataFrame,
    keys: Sequence[str],
    families: Sequence[str] = ALL_FAMILIES,
    split: Split = Split(),
) -> DataFrame:
    """One row per key: ``pos_<f>``, ``neg_<f>`` and ``twice_<f>_<g>`` for every family pair."""
    y, family, n = F.col("y"), F.col("family"), counts_of(scored)
    aggs = []
    for f in families:
        aggs.append(F.sum(((family == f) & (y == 1)).cast("bigint") * n).alias(f"pos_{f}"))
        aggs.append(F.sum(((family == f) & (y == 0)).cast("bigint") * n).alias(f"neg_{f}"))
    counts = scored.groupBy(*keys, "score").agg(*aggs)
    negatives = [f"neg_{f}" for f in families]
    ranked = running_sum(checkpointed(counts), list(keys), "score", negatives, split=split)

    def twice(f: str, g: str) -> Column:
        below = (F.col(f"neg_{g}_before") * 2 + F.col(f"neg_{g}")).cast(COUNT)
        return F.sum(F.col(f"pos_{f}").cast(COUNT) * below).alias(f"twice_{f}_{g}")

    return ranked.groupBy(*keys).agg(
        *[F.sum(f"{side}_{f}").alias(f"{side}_{f}") for f in families for side in ("pos", "neg")],
        *[twice(f, g) for f in families for g in families],
    )


def metric_columns(families: Sequence[str] = ALL_FAMILIES) -> dict[str, Column]:
    """The four primary metrics as expressions over a concordance row."""

    def d(name: str) -> Column:
        return F.col(name).cast("double")

    def total(cells: Sequence[Column]) -> Column:
        return sum(cells[1:], cells[0])

    def ratio(pairs: Column, p: Column, n: Column) -> Column:
        return F.try_divide(pairs, F.lit(2.0) * p * n)

    weight = {
        f: F.coalesce(F.try_divide(F.lit(1.0), d(f"pos_{f}") + d(f"neg_{f}")), F.lit(0.0))
        for f in families
    }
    out = {
        "event_weighted_auc": ratio(
            total([d(f"twice_{f}_{g}") for f in families for g in families]),
            total([d(f"pos_{f}") for f in families]),
            total([d(f"neg_{f}") for f in families]),
        ),
        "scenario_balanced_auc": ratio(
            total([weight[f] * weight[g] * d(f"twice_{f}_{g}") for f in families for g in families]),
            total([weight[f] * d(f"pos_{f}") for f in families]),
            total([weight[f] * d(f"neg_{f}") for f in families]),
        ),
    }
    for f in ("manipulation", "recon"):
        # Normal-family rows enter a pair whatever their label; the other family only as attacks.
        out[f"{f}_vs_normal_auc"] = ratio(
            d(f"twice_{f}_normal") + d("twice_normal_normal"),
            d(f"pos_{f}") + d("pos_normal"),
            d("neg_normal"),
        )
    return out


def primary_metrics(
    scored: DataFrame, keys: Sequence[str], split: Split = Split()
) -> DataFrame:
    """Event-weighted, family-balanced and the two pairwise AUCs, one row per key."""
    table = concordance(scored, keys, split=split)
    return table.select(*keys, *[c.alias(name) for name, c in metric_columns().items()])


def balanced_weights(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weight of one row of each family such that every family totals one."""
    sizes = df.groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("family_rows"))
    return sizes.withColumn("weight", F.lit(1.0) / F.col("family_rows"))


def ensemble_score(
    scores: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), order: str = "seed"
) -> DataFrame:
    """Arithmetic mean of the seeds' scores per event; ``carry`` columns are constant per event.

    Added up in seed order: a double sum in arrival order would break ties between events. The
    list per event is as long as the seed list. Scores held as one column per seed need no such
    grouping, see :func:`driftline.plans.scoring.ensemble_mean`.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, "score")))
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["score"])
    return scores.groupBy(*keys).agg(
        (total / F.count(F.lit(1))).alias("score"),
        F.count(F.lit(1)).alias("n_scores"),
        *[F.first(c).alias(c) for c in carry],
    )


def long_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Turn metric columns into ``(keys, metric, value)`` rows."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")
