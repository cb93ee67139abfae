"""Prefix sums, lags, carried values and exact quantiles that stay parallel on hot keys.

A plain window sends every row of a key to one task. Each operator here first counts rows per
key (a map-side combined aggregate). If no key is larger than ``limit`` the plain window is the
right plan and is used as is. Otherwise rows are dealt by ranges of (key, order, tie) into segments
of about ``limit`` rows and written; windows run per (key, segment), one summary row per segment is
carried across segments and joined back. A hot key, even a hot stamp within a key, is spread over
tasks, and a retried task sees the same segments. Null keys are keys like any other.

Counting reads the input once more. Callers therefore pass either a scan, of which the count needs
the key column only, or an aggregate they have checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialize, shared_dir

ROW_LIMIT = 5_000_000
#: Segments are files, so there are no more of them unless each would exceed ``ROW_LIMIT`` rows.
MOST_SEGMENTS = 256
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Split:
    """When to cut keys: above ``limit`` rows of one key, into segments of about as many (see ``_segments``)."""

    limit: int = ROW_LIMIT


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Checkpoint a narrow lookup table and broadcast it only if its row count is within bounds.

    Above the bound the table is returned unhinted and joins shuffle, with adaptive skew splits.
    """
    table = checkpointed(df)
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def _segments(df: DataFrame, keys: list[str], order: list[str], split: Split) -> DataFrame | None:
    """Rows with ``_segment``, or None where no key exceeds the limit.

    Rows are dealt by ranges of (keys, order) and written, so that a retried task sees the same
    segments. Cuts may fall anywhere, also among rows of one key and one stamp; segment numbers
    ascend with the order. A ``limit`` that is tiny beside the table gives ``MOST_SEGMENTS`` larger
    segments; their number grows only with segments of ``ROW_LIMIT`` rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    size = counts.agg(F.max("_rows").alias("largest"), F.sum("_rows").alias("rows")).first()
    if (size["largest"] or 0) <= split.limit:
        return None
    most = max(MOST_SEGMENTS, ceil(size["rows"] / ROW_LIMIT))
    dealt = df.repartitionByRange(min(ceil(size["rows"] / split.limit), most), *keys, *order)
    return materialize(dealt.withColumn("_segment", F.spark_partition_id()), "segments")


def _join_carry(rows: DataFrame, carry: DataFrame, parts: list[str]) -> DataFrame:
    """``rows`` with the columns of their segment; null keys meet null keys."""
    named = carry.select(*[F.col(c).alias(f"_at_{c}" if c in parts else c) for c in carry.columns])
    same = [rows[c].eqNullSafe(named[f"_at_{c}"]) for c in parts]
    return rows.join(named, same).drop(*[f"_at_{c}" for c in parts])


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], bool]:
    return (df, keys, False) if keys else (df.withColumn("_all", F.lit(0)), ["_all"], True)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: list[str],
    tie: list[str] | None = None,
    split: Split = Split(),
) -> DataFrame:
    """Add ``<c>_before`` (sum over strictly earlier rows) and ``<c>_total`` (sum over the key)."""
    df, keys, dummy = _keyed(df, keys)
    ordering = [order, *(tie or [])]
    rows = _segments(df, keys, ordering, split)
    if rows is None:
        group = Window.partitionBy(*keys)
        before = group.orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
        out = df
        for c in columns:
            out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(before), F.lit(0)))
            out = out.withColumn(f"{c}_total", F.sum(c).over(group))
        return out.drop("_all") if dummy else out

    parts = [*keys, "_segment"]
    sums = rows.groupBy(*parts).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    over_segments = Window.partitionBy(*keys)
    earlier = over_segments.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *parts,
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_carry") for c in columns],
        *[F.sum(f"_{c}").over(over_segments).alias(f"{c}_total") for c in columns],
    )
    inside = Window.partitionBy(*parts).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for c in columns:
        out = out.withColumn(f"_{c}_inside", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = _join_carry(out, carry, parts)
    for c in columns:
        out = out.withColumn(f"{c}_before", F.col(f"_{c}_inside") + F.col(f"_{c}_carry"))
    names = [c for c in df.columns if c != "_all" or not dummy]
    return out.select(*names, *[f"{c}_{s}" for c in columns for s in ("before", "total")])


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: list[str],
    columns: list[str],
    split: Split = Split(),
) -> DataFrame:
    """Add ``previous``: a struct of ``columns`` from the preceding row of the key, null on the first."""
    payload = F.struct(*columns)
    rows = _segments(df, keys, [order, *tie], split)
    if rows is None:
        w = Window.partitionBy(*keys).orderBy(order, *tie)
        return df.withColumn("previous", F.lag(payload).over(w))

    parts = [*keys, "_segment"]
    last = rows.groupBy(*parts).agg(F.max_by(payload, F.struct(order, *tie)).alias("_last"))
    over_segments = Window.partitionBy(*keys).orderBy("_segment")
    carry = last.select(*parts, F.lag("_last").over(over_segments).alias("_carry"))
    inside = Window.partitionBy(*parts).orderBy(order, *tie)
    out = _join_carry(rows.withColumn("_inside", F.lag(payload).over(inside)), carry, parts)
    return out.select(*df.columns, F.coalesce("_inside", "_carry").alias("previous"))


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: list[str],
    value: Column,
    name: str,
    split: Split = Split(),
) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` at or before each row of the key."""
    df = df.withColumn(name, value)
    rows = _segments(df, keys, [order, *tie], split)
    if rows is None:
        w = Window.partitionBy(*keys).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(name, ignorenulls=True).over(w))

    parts = [*keys, "_segment"]
    last = rows.groupBy(*parts).agg(
        F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.struct(order, *tie))).alias("_last")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = last.select(*parts, F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*parts).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_carry(rows.withColumn("_inside", F.last(name, ignorenulls=True).over(inside)), carry, parts)
    names = [c for c in df.columns if c != name]
    return out.select(*names, F.coalesce("_inside", "_carry").alias(name))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    split: Split = Split(),
) -> DataFrame:
    """Exact linear-interpolated quantiles per key from value counts, plus the row count ``n``.

    ``percentile`` would hold every distinct value of a key in one task; here values are counted
    with map-side combine and ranks come from :func:`running_sum`.
    """
    df, keys, dummy = _keyed(df.filter(F.col(value).isNotNull()), keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(checkpointed(counts), keys, value, ["_n"], split=split)
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    aggs = []
    for name, q in quantiles.items():
        at = (F.col("_n_total") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = F.when(rank.between(first, last), F.col(value).cast("double"))
            aggs.append(F.max(hit).alias(f"_{name}_{side}"))
    picked = ranked.groupBy(*keys).agg(F.max("_n_total").alias("n"), *aggs)
    out = picked
    for name, q in quantiles.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, lo + (hi - lo) * (at - F.floor(at)))
    return out.select(*([] if dummy else keys), "n", *quantiles)
