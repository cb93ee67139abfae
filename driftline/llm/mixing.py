"""Mixing sources to target weights by Poisson replication.

A source of size ``s`` (code points plus one per document) with target weight ``w`` gets the mean
repetition rate ``w * budget * total / s``. Each document draws its number of copies from a Poisson
distribution of that mean by inverting its cumulative distribution at a hash of (seed, doc_id), is
exploded into that many rows, and all rows are put into a random order that is a hash of (seed,
doc_id, copy). Nothing is drawn at run time: retried tasks produce the same rows.

Only DataFrame functions are used. Per-source sums are combined map-side, so a source that holds a
third of all rows is no hot task; the exchange is by the hash of each copy.

Edge cases: a null source is a source of its own, a null or empty text has size one, a null doc_id
draws as the empty id, rows with one doc_id draw the same count, and an empty table gives an empty
table. Input columns named like the added ones (``copy``, ``shuffle_key``) are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.frames import without
from driftline.session import materialize

#: Means above this are drawn as a sum of equal parts, so that exp(-mean) keeps its precision.
PART = 32.0
SEED = 20


def uniform(*parts: Column) -> Column:
    """Hash of the parts as a double strictly between 0 and 1, on a grid of 2**-52."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    whole = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(2**52))


def source_rates(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, budget: float = 1.0,
    source: str = "source", text: str = "text",
) -> DataFrame:
    """One row per source: its size, target weight and mean repetition rate.

    Without ``weights`` the target is proportional to ``size ** power``. With them, a source that is
    not listed gets weight 0; weights are normalised over the sources present.
    """
    size = F.coalesce(F.char_length(text), F.lit(0)).cast("long") + F.lit(1)
    sizes = docs.groupBy(F.col(source).alias("_mix_source")).agg(F.sum(size).alias("_mix_size"))
    if weights is None:
        weight = F.pow(F.col("_mix_size").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = materialize(sizes.withColumn("_mix_weight", weight), "mix-sizes")
    total, norm = sizes.agg(F.sum("_mix_size"), F.sum("_mix_weight")).first()
    share = F.col("_mix_weight") / F.lit(float(norm or 1.0))
    return sizes.withColumn("_mix_share", share).withColumn(
        "_mix_rate", share * F.lit(budget * float(total or 0)) / F.col("_mix_size").cast("double")
    )


def _cumulative(mean: Column) -> Column:
    """Poisson cumulative probabilities of 0, 1, 2, ... up to a tail below double precision."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(24.0)).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def copy_counts(docs: DataFrame, rates: DataFrame, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``_mix_n``, the number of copies of each document."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("_mix_rate") / F.lit(PART)).cast("int"))
    table = rates.select(
        "_mix_source", parts.alias("_mix_parts"), _cumulative(F.col("_mix_rate") / parts).alias("_mix_cdf")
    )
    drawn = docs.join(table, docs[source].eqNullSafe(table["_mix_source"]), "left")

    def one(acc: Column, part: Column) -> Column:
        u = uniform(F.lit("count"), F.lit(seed), F.col(key), part)
        return acc + F.size(F.filter("_mix_cdf", lambda c: c <= u))

    n = F.aggregate(F.sequence(F.lit(1), F.col("_mix_parts")), F.lit(0), one)
    return drawn.withColumn("_mix_n", n).drop("_mix_source", "_mix_parts", "_mix_cdf")


def mix_sources(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, budget: float = 1.0,
    seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Documents repeated to the target mix, in global random order, with ``copy`` (from 1) and ``shuffle_key``."""
    docs = without(docs, "copy", "shuffle_key")
    rates = source_rates(docs, weights, power, budget, source, text)
    counted = copy_counts(docs, rates, seed, key, source).where(F.col("_mix_n") > 0)
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).drop("_mix_n")
    place = F.md5(F.concat_ws("|", F.lit("place"), F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy")))
    return copies.withColumn("shuffle_key", place).orderBy("shuffle_key")
