"""Threshold choice under a false-positive budget, and the rates measured at a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import next_double
from driftline.operators.ordered import Split, checkpointed, running_sum, small_side
from driftline.operators.ranking import counts_of

NO_NEGATIVES_THRESHOLD = 0.5


def _negative_suffix(scored: DataFrame, keys: Sequence[str], split: Split) -> DataFrame:
    """Per distinct score: negatives at it, negatives at or above it, and all negatives."""
    negative = (F.col("y") == 0).cast("bigint") * counts_of(scored)
    counts = scored.groupBy(*keys, "score").agg(F.sum(negative).alias("neg"))
    ranked = running_sum(checkpointed(counts), list(keys), "score", ["neg"], split=split)
    return ranked.withColumn("at_or_above", F.col("neg_total") - F.col("neg_before"))


def fpr_curve(scored: DataFrame, keys: Sequence[str], split: Split = Split()) -> DataFrame:
    """Share of negatives at or above each observed negative score."""
    rows = _negative_suffix(scored, keys, split).filter(F.col("neg") > 0)
    return rows.select(
        *keys, "score", "at_or_above", (F.col("at_or_above") / F.col("neg_total")).alias("fpr")
    )


def threshold_at_fpr(
    scored: DataFrame, keys: Sequence[str], max_fpr: float, split: Split = Split()
) -> DataFrame:
    """Least observed negative score whose false-positive rate under ``>=`` is within budget.

    When no observed score is, the next double above the largest negative score; without any
    negative, one half. The rate falls as the score rises, so a minimum is all the search needed.
    """
    rows = _negative_suffix(scored, keys, split)
    negative = F.col("neg") > 0
    within = F.col("at_or_above") / F.col("neg_total") <= F.lit(max_fpr)
    best = rows.groupBy(*keys).agg(
        F.min(F.when(negative & within, F.col("score"))).alias("_best"),
        F.max(F.when(negative, F.col("score"))).alias("_top"),
    )
    threshold = F.coalesce("_best", next_double(F.col("_top")), F.lit(NO_NEGATIVES_THRESHOLD))
    return best.select(*keys, threshold.alias("threshold"))


def apply_threshold(scored: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``threshold`` and the binary ``pred``; thresholds are one row per key."""
    joined = scored.join(small_side(thresholds), list(keys))
    return joined.withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))


def rate(mask: Column, pred: str = "pred", n: Column | None = None) -> Column:
    """Mean prediction over the mask, of rows that stand for ``n`` events; null when the mask is empty."""
    if n is None:
        return F.avg(F.when(mask, F.col(pred)))
    return F.try_divide(F.sum(F.when(mask, F.col(pred) * n)), F.sum(F.when(mask & F.col(pred).isNotNull(), n)))


def seed_counts(wide: DataFrame, thresholds: DataFrame, seeds: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Per cell of ``by`` and seed: ``n_rows``, ``n_hits`` at the seed's threshold, ``n_pred`` (rows with a
    prediction) and ``n_bad`` (scores that are no finite number).

    ``wide`` has one column ``score_<seed>`` per seed. They are counted side by side in one pass; no row is
    repeated by seed. ``thresholds`` is ``(schema, seed, threshold)``, and ``by`` holds ``schema``.
    """
    cuts = thresholds.groupBy("schema").pivot("seed", list(seeds)).agg(F.first("threshold"))
    cuts = cuts.select("schema", *[F.col(f"`{s}`").alias(f"_cut_{s}") for s in seeds])
    aggs = []
    for s in seeds:
        score, pred = F.col(f"score_{s}"), (F.col(f"score_{s}") >= F.col(f"_cut_{s}")).cast("bigint")
        finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
        aggs += [F.sum(pred).alias(f"_hits_{s}"), F.count(pred).alias(f"_pred_{s}"), F.count(F.when(~finite, 1)).alias(f"_bad_{s}")]
    cells = wide.join(small_side(cuts), "schema", "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    each = F.array(*[
        F.struct(F.lit(s).alias("seed"), F.col(f"_hits_{s}").alias("n_hits"), F.col(f"_pred_{s}").alias("n_pred"), F.col(f"_bad_{s}").alias("n_bad"))
        for s in seeds
    ])
    return cells.select(*by, "n_rows", F.inline(each))


def counted_predictions(cells: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of :func:`seed_counts` as rows with ``pred`` and ``n_rows``; keys without a threshold have none."""
    kept = [c for c in cells.columns if not c.startswith("n_")]
    sides = F.array(
        F.struct(F.lit(1).alias("pred"), F.col("n_hits").alias("n_rows")),
        F.struct(F.lit(0).alias("pred"), (F.col("n_pred") - F.col("n_hits")).alias("n_rows")),
        F.struct(F.lit(None).cast("int").alias("pred"), (F.col("n_rows") - F.col("n_pred")).alias("n_rows")),
    )
    rows = cells.join(small_side(thresholds.select(*keys)), list(keys))
    return rows.select(*kept, F.inline(sides)).filter(F.col("n_rows") > 0)


def _counted(predicted: DataFrame) -> Column | None:
    return counts_of(predicted) if "n_rows" in predicted.columns else None


def _mask(family: str, y: int) -> Column:
    return (F.col("family") == family) & (F.col("y") == y)


def threshold_metrics(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Benign rates and attack recalls at the threshold, per key."""
    n = _counted(predicted)
    return predicted.groupBy(*keys).agg(
        rate(_mask("normal", 0), n=n).alias("normal_fpr"),
        rate(_mask("fault", 0), n=n).alias("fault_fpr"),
        rate(_mask("manipulation", 1), n=n).alias("manipulation_recall"),
        rate(_mask("recon", 1), n=n).alias("recon_recall"),
    )


def event_rates(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates with the row counts behind them; an empty mask gives null, not an error."""
    aggs = []
    for family in ("normal", "fault"):
        m = _mask(family, 0)
        aggs += [rate(m).alias(f"fpr_{family}"), F.count(F.when(m, 1)).alias(f"n_{family}")]
    for family in ("manipulation", "recon"):
        m = _mask(family, 1)
        aggs += [
            rate(m).alias(f"recall_event_{family}"),
            F.count(F.when(m, 1)).alias(f"n_{family}_attack_rows"),
        ]
    return predicted.groupBy(*keys).agg(*aggs)


def stress_fpr(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """False-positive rate averaged over (run, scenario) cells, and over events."""
    n = counts_of(predicted)
    cells = predicted.groupBy(*keys, "run_id", "scenario").agg(
        F.sum(F.col("pred") * n).alias("_hits"), F.sum(n).alias("_rows")
    )
    return cells.groupBy(*keys).agg(
        F.avg(F.col("_hits") / F.col("_rows")).alias("run_scenario_balanced_false_positive_rate"),
        (F.sum("_hits") / F.sum("_rows")).alias("event_weighted_false_positive_rate"),
    )


def validation_fpr(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predicted.groupBy(*keys).agg(rate(F.col("y") == 0, n=_counted(predicted)).alias("validation_fpr"))


def median_min_max(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Median, extremes and count over seeds; a seed list bounds the rows of each key."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return values.groupBy(*keys).agg(
        F.median(value).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(F.lit(1)).alias("n"),
        F.bool_and(finite).alias("finite"),
    )


def mean_min_max(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and extremes over seeds, nulls skipped; metrics without any value are left out."""
    return (
        values.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    )
