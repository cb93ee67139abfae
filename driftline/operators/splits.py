"""Seeded run-level splits: seeds are rows and the shuffle is a replayable hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import hash32
from driftline.operators.ordered import Split, checkpointed, running_sum, small_side

TRAIN, VALIDATION = "train", "validation"
#: Low bits of the 32-bit hash order that the cells of a row split leave out.
CELL_BITS = 24


def with_seeds(df: DataFrame, seeds: list[int]) -> DataFrame:
    """Repeat each row once per seed: seeds are data, not a driver loop."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def _position(df: DataFrame, key: str, split: Split) -> DataFrame:
    """Zero-based place of each row in its seed's hash order, and the row count of the seed."""
    ranked = df.withColumn("_h", hash32("seed", key)).withColumn("_one", F.lit(1))
    return running_sum(ranked, ["seed"], "_h", ["_one"], tie=[key], split=split)


def _cut(n: str, validation_fraction: float):
    return F.floor(F.col(n) * F.lit(1.0 - validation_fraction))


def split_by_run(
    df: DataFrame, seeds: list[int], validation_fraction: float = 0.3, split: Split = Split()
) -> DataFrame:
    """``(seed, run_id, side)``: the first ``cut`` runs in hash order train, the rest validate."""
    runs = with_seeds(df.select("run_id").distinct(), seeds)
    placed = _position(runs, "run_id", split)
    n = F.col("_one_total")
    cut = F.greatest(F.lit(1), F.least(n - 1, _cut("_one_total", validation_fraction)))
    side = F.when(F.col("_one_before") < cut, TRAIN).otherwise(VALIDATION)
    return placed.select("seed", "run_id", side.alias("side"))


def split_rows(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Each row once per seed with its side; the split table is broadcast only if it is small."""
    return df.join(small_side(splits), "run_id")


def _last_training_row(df: DataFrame, seeds: list[int], validation_fraction: float, split: Split) -> DataFrame:
    """``(seed, _last)``: hash and id of each seed's last training row; no row where none trains.

    Rows are counted per cell of the hash order; only those of the cell in which the cut falls are ranked,
    so that neither the rows nor their hashes are shuffled or written.
    """
    hashed = with_seeds(df, seeds).withColumn("_h", hash32("seed", "event_id"))
    hashed = hashed.withColumn("_cell", F.shiftright("_h", CELL_BITS))
    cells = checkpointed(hashed.groupBy("seed", "_cell").agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_sum(cells, ["seed"], "_cell", ["_n"], split=split)
    rank = _cut("_n_total", validation_fraction) - F.col("_n_before")
    hit = ranked.select("seed", "_cell", "_n", rank.alias("_rank")).filter(F.col("_rank").between(1, F.col("_n")))
    near = hashed.join(small_side(hit.drop("_n")), ["seed", "_cell"]).withColumn("_one", F.lit(1))
    placed = running_sum(checkpointed(near), ["seed"], "_h", ["_one"], tie=["event_id"], split=split)
    return placed.filter(F.col("_one_before") == F.col("_rank") - 1).select("seed", F.struct("_h", "event_id").alias("_last"))


def split_with_basis(
    df: DataFrame, seeds: list[int], validation_fraction: float = 0.3, split: Split = Split()
) -> DataFrame:
    """Rows with ``seed``, ``side`` and the basis of the split.

    With fewer than two runs a run split is impossible: rows are split in hash order instead and
    the basis ``row`` lets the contracts refuse it.
    """
    runs = df.select("run_id").filter(F.col("run_id").isNotNull()).distinct().limit(2).count()
    if runs >= 2:
        splits = split_by_run(df, seeds, validation_fraction, split)
        return split_rows(df, splits).withColumn("basis", F.lit("run"))
    last = _last_training_row(df.select("event_id"), seeds, validation_fraction, split)
    rows = with_seeds(df, seeds).join(small_side(last), "seed", "left")
    here = F.struct(hash32("seed", "event_id").alias("_h"), "event_id")
    side = F.when(here <= F.col("_last"), TRAIN).otherwise(VALIDATION)
    return rows.select("seed", *df.columns, side.alias("side"), F.lit("row").alias("basis"))


def split_profile(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Row counts per ``(seed, side, run_id, label)`` of a run-level split.

    Rows are counted per run and label before the split table multiplies them by the seeds.
    """
    counts = df.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(splits, "run_id").withColumn("basis", F.lit("run"))


def row_split_profile(rows: DataFrame) -> DataFrame:
    """The same counts from rows that were split one by one."""
    return rows.groupBy("seed", "side", "run_id", "label", "basis").agg(F.count(F.lit(1)).alias("n_rows"))
