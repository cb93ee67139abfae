"""Nearest neighbours by cosine with learned binary codes and multi-index hashing.

Vectors are brought to unit length, turned to their principal axes and rotated so that their signs
lose least (iterative quantisation). Several such rotations, each from another start, give one long
code. The code is cut into substrings of 16 bits, and each substring is a table from its value to rows.
A query looks up the Hamming ball of ``reach`` bits around each of its substrings. By the pigeonhole
principle that finds every code within ``tables * (reach + 1) - 1`` bits, and most codes well beyond.
What is found is verified on the whole code against ``radius`` and ranked by the cosine of the original
vectors.

Rotations, radius, number of tables and reach are fitted on a bounded sample (``SAMPLE_ROWS``): the
radius holds ``WITHIN`` of the true neighbours inside the sample, and the fewest tables are taken that
find ``COVER`` of them. Every row is indexed, once, in the block that a hash of its id names; queries go
to every block. A query keeps its best of each block, and these few rows are merged. Queries for which
fewer than ``k`` rows were found are compared with all rows in a second pass.

Of rows with equal vectors only the ``k + 1`` smallest ids are candidates, as ties go to smaller ids: no
other can be among the nearest ``k``. So a vector that holds a third of all rows costs no more than others.

Nearness is worked out in double precision, row by row in one fixed order, so equal vectors tie
exactly, and ties go to the smaller id. Vectors are first scaled by a power of two, which changes no digit
and keeps squares of very large and very small components in range. Edge cases: vectors that are null,
empty, zero, of another length than most, or hold null or non-finite parts take no part; of rows that
share an id the one whose vector sorts first counts; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialize

SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 512
#: Shares of the sample's true neighbours that the tables find, and that the radius holds.
COVER = 0.96
WITHIN = 0.99
#: Bits of one rotation at most, bits of a substring, and substrings at most.
MAX_BITS = 256
WIDTH = 16
MOST_TABLES = 128
ROUNDS = 20
SEED = 5
#: Vectors of one block, in bytes of doubles.
BLOCK_BYTES = 32 << 20
#: Small tables are still cut into about this many blocks.
LEAST_BLOCKS = 12
#: Vectors coded, and queries marked, at once.
CODED, ASKED = 2048, 32
FOUND = "query_id long, vec_id long, score double"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest magnitude to between 1/2 and 1."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0, keepdims=True))
    return np.ldexp(vectors, -exponent)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query, all scaled; each row is summed alone, so equal rows are equal."""
    return (vectors * query).sum(axis=1) / (norms(vectors) * np.sqrt((query * query).sum()))


def ball(reach: int) -> np.ndarray:
    """All substrings with at most ``reach`` bits set."""
    masks = [sum(1 << i for i in bits) for n in range(reach + 1) for bits in combinations(range(WIDTH), n)]
    return np.array(masks, dtype=np.uint16)


@dataclass(frozen=True)
class Coder:
    """Projection to codes, the radius in which neighbours are looked for, and the reach in each table."""

    axes: np.ndarray
    radius: int
    reach: int

    def substrings(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        out = np.empty((len(vectors), self.axes.shape[1] // WIDTH), dtype=np.uint16)
        for start in range(0, len(vectors), CODED):
            signs = unit(vectors[start:start + CODED]) @ self.axes > 0
            out[start:start + CODED] = np.packbits(signs, axis=1).view(np.uint16)
        return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _rotations(x: np.ndarray, bits: int) -> np.ndarray:
    """Axes of at least ``bits`` signs of the unit vectors ``x``, from as many rotations as it takes."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :MAX_BITS]
    projected, wide = x @ axes, axes.shape[1]
    random, out = np.random.default_rng(SEED), []
    for _ in range(-(-bits // wide)):
        rotation, _ = np.linalg.qr(random.standard_normal((wide, wide)))
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
            rotation = (u @ w).T
        out.append(axes @ rotation)
    return np.concatenate(out, axis=1)[:, :bits]


def fit(vectors: np.ndarray, neighbours: int, cover: float = COVER) -> Coder:
    """Rotations, tables, reach and radius from distinct sample vectors."""
    x = unit(vectors)
    axes = _rotations(x, MOST_TABLES * WIDTH)
    near = x[:SAMPLE_QUERIES] @ x.T
    near[np.arange(len(near)), np.arange(len(near))] = -np.inf
    k = min(neighbours, len(x) - 1)
    if k < 1:
        return Coder(axes[:, :WIDTH], WIDTH, WIDTH)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    codes = Coder(axes, 0, 0).substrings(vectors)
    differ = np.bitwise_count(codes[:len(near), None, :] ^ codes[best])
    for reach in range(2, WIDTH + 1):
        found = np.logical_or.accumulate(differ <= reach, axis=2).mean(axis=(0, 1))
        if found[-1] >= cover:
            break
    tables = int(np.argmax(found >= cover)) + 1
    distance = differ[:, :, :tables].sum(axis=2, dtype=np.int64)
    radius = int(np.quantile(distance, WITHIN, method="higher"))
    return Coder(axes[:, :tables * WIDTH], radius, reach)


class Index:
    """Tables over the substrings of a block's codes. Ids are distinct."""

    def __init__(self, coder: Coder, ids: np.ndarray, vectors: np.ndarray):
        self.coder, self.ids, self.vectors = coder, ids, scaled(vectors)
        self.codes = coder.substrings(self.vectors)
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in self.codes.T]
        self.sorted = [c[o] for c, o in zip(self.codes.T, self.order)]
        self.ball = ball(coder.reach)

    def probed(self, codes: np.ndarray) -> np.ndarray:
        """For each query code the rows that some table gives, as a table of marks."""
        marks = np.zeros((len(codes), len(self.ids)), dtype=bool)
        for asked, order, values in zip(codes.T, self.order, self.sorted):
            probes = (asked[:, None] ^ self.ball).ravel()
            first = np.searchsorted(values, probes, "left")
            size = np.searchsorted(values, probes, "right") - first
            query = np.repeat(np.arange(len(codes)), size.reshape(len(codes), -1).sum(axis=1))
            at = np.arange(len(query)) + np.repeat(first - (np.cumsum(size) - size), size)
            marks[query, order[at]] = True
        return marks

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, all_rows: bool = False) -> pd.DataFrame:
        """The ``k`` nearest rows found for each query, its own id left out; with ``all_rows`` the nearest of all."""
        out = []
        for start in range(0, len(queries), ASKED):
            asked = scaled(queries[start:start + ASKED])
            codes = self.coder.substrings(asked)
            marks = None if all_rows else self.probed(codes)
            for i, query_id in enumerate(query_ids[start:start + ASKED]):
                rows = np.arange(len(self.ids)) if all_rows else np.flatnonzero(marks[i])
                if not all_rows:
                    rows = rows[apart(self.codes[rows], codes[i]) <= self.coder.radius]
                rows = rows[self.ids[rows] != query_id]
                score = cosines(self.vectors[rows], asked[i])
                best = np.lexsort((self.ids[rows], -score))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": self.ids[rows[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part, one for each id."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))
    rows = rows.where(
        F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("vec") == (sizes[0]["size"] if sizes else 0))
    # Limits by rank are applied before the exchange as well, so no id and no vector is hot.
    return _first(rows, "id", "vec", 1)


def _first(rows: DataFrame, of: str, by: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(of).orderBy(by))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _searcher(coder: Coder, k: int, all_rows: bool):
    """Streams rows sorted by block, a block's own rows before its queries: only one block is held."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, index = None, [], None
        for batch in batches:
            for (number, asks), part in batch.groupby(["block", "asks"], sort=True):
                if number != block:
                    block, held, index = number, [], None
                ids, vectors = part["id"].to_numpy(), np.stack(part["vec"].to_numpy())
                if not asks:
                    held.append((ids, vectors))
                elif held:
                    if index is None:
                        index = Index(coder, *(np.concatenate(x) for x in zip(*held)))
                    yield index.search(ids, vectors, k, all_rows)

    return search


def nearest(
    vectors: DataFrame, query_every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    block_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``query_every``, the
    ``k`` nearest rows found, ranks from 1."""
    rows = materialize(usable(vectors, key, vector), "ann-rows")
    kept = materialize(_first(rows, "vec", "id", k + 1), "ann-kept")
    n, n_kept = rows.count(), kept.count()
    place = F.xxhash64(F.lit("sample"), "id")
    share = min(1.0, SAMPLE_ROWS / max(1, n_kept))
    drawn = kept.where(F.pmod(place, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).orderBy(place, "id")
    drawn = drawn.limit(2 * SAMPLE_ROWS).toPandas()
    coder = fit(np.stack(drawn["vec"].to_numpy()), k) if len(drawn) else None
    block_rows = block_rows or max(1024, BLOCK_BYTES // (8 * (len(drawn["vec"][0]) if len(drawn) else 1)))
    blocks = max(-(-n_kept // block_rows), min(LEAST_BLOCKS, -(-n_kept // 1024)), 1)
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int")
    indexed = kept.select("id", "vec", F.lit(False).alias("asks"), block.alias("block"))

    def best(queries: DataFrame, all_rows: bool) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        asked = queries.select("id", "vec", F.lit(True).alias("asks"), every)
        dealt = indexed.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks")
        return materialize(dealt.mapInPandas(_searcher(coder, k, all_rows), FOUND), "ann-found")

    queries = rows.where(F.col("id") % query_every == 0)
    found = best(queries, False)
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
    rest = materialize(queries.join(enough, queries["id"] == enough["query_id"], "left_anti"), "ann-rest")
    if not rest.isEmpty():
        again = rest.select(F.col("id").alias("query_id"))
        found = found.join(again, "query_id", "left_anti").unionByName(best(rest, True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
