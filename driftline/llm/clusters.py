"""Centroid clustering of whole-number vectors with a vector-approximation file.

Beside each vector lies its approximation: six bits per dimension name the cell its component falls in.
The cells of a dimension are cut at quantiles of all rows, closer in the tails. For a set of centroids, lookup
tables hold the least and the largest part that a cell allows in the squared distance; summed over the cells of a row they give
an interval per centroid. Distances are taken less the distance to the centroids' common middle: that is the same for
all centroids of a row, so their order stays, and the intervals become several times narrower. A centroid whose
interval lies above another's is out. Where one centroid is left, the row is settled by its cells alone; only where
intervals overlap is the full vector fetched, and compared exactly with the centroids that are left.

One round is one stage: the scan, the lookup (which receives nothing but the cells), the exact comparison
(which receives a vector where intervals overlap and nothing elsewhere), and sums per centroid that are
combined before their exchange, so a centroid that holds most rows is no hot task. The means need every vector
anyway, so cells and vectors share one table and there is no join. The driver sees one row per
centroid and round.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part;
neither do vectors with a component of 2**27 or more after scaling, whose squared distances could leave 64
bits. Repeated rows and repeated ids all count. A row without an id is clustered as well; it starts a centroid
only if there are too few others. Fewer rows than centroids give as many centroids as rows. No rows give no
rows. Sums of distances beyond 64 bits are null. Input columns other than id and vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import cos, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Bits per dimension of the approximation.
BITS = 6
#: Scaled components stay below this, so that a squared distance fits 64 bits.
LARGEST = 1 << 27
#: Bits of the mask of centroids that are left.
MOST_CENTROIDS = 60
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass(frozen=True)
class Cells:
    """Least and largest value of each cell of each dimension."""

    starts: np.ndarray  # (dimensions, cells)
    ends: np.ndarray

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Cell numbers, a byte each."""
        cells = np.empty(vectors.shape, dtype=np.uint8)
        for d, starts in enumerate(self.starts):
            cells[:, d] = np.searchsorted(starts[1:], vectors[:, d], side="right")
        return cells

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimensions, cells, centroids): least and largest part of the squared distance, less that to the middle.

        That difference is linear in the component, so a cell's bounds are at its ends."""
        middle = centroids.sum(axis=0) // len(centroids)
        at = lambda x: (x[:, :, None] - centroids.T[:, None, :]) ** 2 - ((x - middle[:, None]) ** 2)[:, :, None]
        low, high = at(self.starts), at(self.ends)
        return np.minimum(low, high), np.maximum(low, high)


@dataclass
class Clustering:
    """The rows with their results, the final centroids, and the share of rows fetched in each assignment."""

    rows: DataFrame
    centroids: list[list[int]]
    fetched: list[float] = field(default_factory=list)


def kept(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, vec) of the rows that take part, components scaled and rounded down."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * F.lit(float(scale)) < F.lit(float(LARGEST)))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.coalesce((F.size("v") == dimensions) & F.forall("v", fits), F.lit(False)))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vec"))


def first_centroids(rows: DataFrame, centroids: int = CENTROIDS) -> list[list[int]]:
    """Vectors of the rows whose ids have the smallest hashes, in the order of the hashes."""
    mark = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    order = [F.asc_nulls_last("mark"), "id", "vec"]
    return [list(r["vec"]) for r in rows.select(mark.alias("mark"), "id", "vec").orderBy(*order).limit(centroids).collect()]


def fit_cells(rows: DataFrame, dimensions: int = DIMENSIONS) -> Cells:
    """Cells cut at quantiles over all rows, closer in the tails, where values lie far apart."""
    count = 1 << BITS
    at = [(1 - cos(pi * i / count)) / 2 for i in range(1, count)]
    value = lambda d: F.col("vec")[d]
    found = rows.agg(
        F.array(*[F.min(value(d)) for d in range(dimensions)]), F.array(*[F.max(value(d)) for d in range(dimensions)]),
        F.array(*[F.percentile_approx(value(d), at, 1000) for d in range(dimensions)]),
    ).first()
    least, most, cuts = (np.array(f, dtype=np.int64) for f in found)
    starts = np.concatenate([least[:, None], np.clip(np.sort(cuts, axis=1), least[:, None], most[:, None])], axis=1)
    # Equal cuts leave cells without values; such a cell is one value wide.
    ends = np.concatenate([np.maximum(starts[:, 1:] - 1, starts[:, :-1]), most[:, None]], axis=1)
    return Cells(starts, ends)


def approximated(rows: DataFrame, cells: Cells) -> DataFrame:
    """The written file: (id, vec, cells)."""

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series([row.tobytes() for row in cells.encode(np.stack(vectors.to_numpy()))])

    return materialize(rows.withColumn("cells", encode("vec")), "approximation")


def nearest_centroid(cells: Cells, centroids: list[list[int]]) -> tuple[Column, Column]:
    """(found, cluster): what the cells say, and the nearest centroid, the smaller number on ties.

    ``found`` is a centroid's number where one is left, else minus the mask of those that are left."""
    middles = np.array(centroids, dtype=np.int64)
    least, most = cells.tables(middles)
    bits = np.int64(1) << np.arange(len(middles), dtype=np.int64)

    @F.pandas_udf("long")
    def by_cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            cell = np.frombuffer(b"".join(batch), dtype=np.uint8).reshape(len(batch), len(least))
            low = np.zeros((len(batch), len(middles)), dtype=np.int64)
            high = np.zeros_like(low)
            for d in range(len(least)):
                low += least[d][cell[:, d]]
                high += most[d][cell[:, d]]
            left = low <= high.min(axis=1, keepdims=True)
            one = left.sum(axis=1) == 1
            yield pd.Series(np.where(one, left.argmax(axis=1), -(left @ bits)))

    @F.pandas_udf("int")
    def exactly(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for found, vectors in batches:
            found = found.to_numpy(dtype=np.int64)
            out = found.copy()
            open_rows = np.flatnonzero(found < 0)
            if len(open_rows):
                full, masks = np.stack(vectors.to_numpy()[open_rows]), -found[open_rows]
                best = np.full(len(full), np.iinfo(np.int64).max)
                for k, middle in enumerate(middles):
                    among = np.flatnonzero(masks & bits[k])
                    apart = full[among] - middle
                    apart = (apart * apart).sum(axis=1)
                    nearer = apart < best[among]
                    best[among[nearer]] = apart[nearer]
                    out[open_rows[among[nearer]]] = k
            yield pd.Series(out.astype(np.int32))

    found = by_cells("cells")
    return found, exactly("found", F.when(F.col("found") < 0, F.col("vec")))


def assign(file: DataFrame, cells: Cells, centroids: list[list[int]]) -> DataFrame:
    """``file`` with ``found`` and ``cluster``."""
    found, cluster = nearest_centroid(cells, centroids)
    return file.withColumn("found", found).withColumn("cluster", cluster)


def moved(assigned: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], float]:
    """Means of the assigned vectors, rounded down (centroids without vectors stay), and the share of rows fetched."""
    sums = F.array(*[F.sum(F.col("vec")[d]) for d in range(len(centroids[0]))])
    totals = assigned.groupBy("cluster").agg(
        sums.alias("sums"), F.count(F.lit(1)).alias("n"), F.sum((F.col("found") < 0).cast("long")).alias("fetched")
    ).collect()
    out = [list(c) for c in centroids]
    for row in totals:
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out, sum(r["fetched"] for r in totals) / max(1, sum(r["n"] for r in totals))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding",
    dimensions: int = DIMENSIONS, scale: int = SCALE,
) -> Clustering:
    """Cluster all rows that take part; see the module's description and ``RESULT``."""
    if not 1 <= centroids <= MOST_CENTROIDS:
        raise ValueError(f"1 to {MOST_CENTROIDS} centroids")
    spark = vectors.sparkSession
    rows = kept(vectors, key, vector, dimensions, scale)
    middles = first_centroids(rows, centroids)
    if not middles:
        return Clustering(spark.createDataFrame([], RESULT), [])
    cells = fit_cells(rows, dimensions)
    file = approximated(rows, cells)
    fetched = []
    for _ in range(rounds):
        middles, share = moved(assign(file, cells, middles), middles)
        fetched.append(share)
    # One row per centroid: small enough to broadcast whatever the input.
    about = spark.createDataFrame(
        [(k, m, digest(m)) for k, m in enumerate(middles)], "cluster int, centroid array<long>, centroid_sha256 string"
    )
    square = lambda a, b: (a - b) * (a - b)
    distance = F.aggregate(F.zip_with("vec", "centroid", square), F.lit(0).cast("long"), lambda s, x: s + x)
    final = materialize(
        assign(file, cells, middles).join(F.broadcast(about), "cluster")
        .select(F.col("id").alias("vec_id"), "cluster", distance.alias("distance"), "centroid_sha256", (F.col("found") < 0).alias("fetched")),
        "clusters",
    )
    inertia = final.groupBy("cluster").agg(
        F.try_sum("distance").alias("cluster_inertia"), F.count(F.lit(1)).alias("n"), F.sum(F.col("fetched").cast("long")).alias("fetched")
    ).collect()
    fetched.append(sum(r["fetched"] for r in inertia) / sum(r["n"] for r in inertia))
    whole = sum(r["cluster_inertia"] for r in inertia) if all(r["cluster_inertia"] is not None for r in inertia) else None
    whole = whole if whole is not None and whole < 1 << 63 else None
    sums = spark.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], whole) for r in inertia], "cluster int, cluster_inertia long, inertia long"
    )
    out = final.join(F.broadcast(sums), "cluster")
    return Clustering(out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), middles, fetched)
