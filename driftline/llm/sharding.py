"""Sharding into shards of near equal bytes by histogram sort.

Documents are ordered by the key (hash of text, hash of doc_id): copies of one text are neighbours
and share a shard unless a splitter falls among them, which the second part of the key makes
possible. Splitters between shards are searched by counting exact bytes below candidate boundaries:
each round divides the key ranges that still hold a splitter into 4,096 cells and sums the bytes of
each cell across all partitions (combined map-side). A splitter is settled when a boundary meets its
target within the tolerance, or at the full 128 bits of the key. Then rows are exchanged once.

The driver sees at most (shards - 1) * 4,096 cell sums a round. Only narrow columns are read in the
rounds. Numbers inside a shard come from counts per (shard, bucket), so no task holds a whole shard.

Edge cases: a null text has size 1 and the checksum of an empty text; rows that agree in text and
doc_id have one key and stay together; a null doc_id hashes like any value; an empty table gives an
empty table. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.frames import without
from driftline.session import materialize

SHARDS = 16
#: A splitter may miss its target by this share of a shard's bytes.
TOLERANCE = 0.001
#: Bits of the key fixed after each round.
DEPTHS = (12, 24, 36, 48, 64, 76, 88, 100, 112, 128)
LEAST = -(1 << 63)
#: Rows that are numbered together.
BUCKET_ROWS = 1024

Key = tuple[int, int]


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, checksum and the two parts of the order key."""
    docs = without(docs, "size", "text_crc32", "shard", "slot")
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        "*", (F.octet_length(body).cast("long") + F.lit(1)).alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("_sh_a"), F.xxhash64(F.lit(9), F.col(key)).alias("_sh_b"),
    )


def _cell(depth: int) -> tuple[Column, Column]:
    """Leading ``depth`` bits of the key, as (part of a, part of b)."""
    if depth <= 64:
        return F.shiftright("_sh_a", 64 - depth), F.lit(0).cast("long")
    return F.col("_sh_a"), F.shiftright("_sh_b", 128 - depth)


def _low(cell: Key, depth: int) -> Key:
    """Smallest key of a cell."""
    return (cell[0] << (64 - depth), LEAST) if depth <= 64 else (cell[0], cell[1] << (128 - depth))


def _past(cell: Key, depth: int) -> Key:
    """Smallest key after a cell; it may lie past every key."""
    if depth <= 64:
        return (cell[0] + 1) << (64 - depth), LEAST
    b = (cell[1] + 1) << (128 - depth)
    return (cell[0], b) if b < 1 << 63 else (cell[0] + 1, LEAST)


def find_splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[Key]:
    """Keys at which shards 1, 2, ... begin, from exact byte counts over all ``rows``."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = max(1, int(tolerance * total / shards))
    settled: dict[int, Key] = {}
    # Target number: the open cell that holds it (at first the whole key range) and the bytes below that cell.
    below: dict[int, tuple[Key | None, int]] = {i: (None, 0) for i in range(1, shards)} if total else {}
    last = 0
    for depth in DEPTHS:
        if not below:
            break
        parents = {cell for cell, _ in below.values() if cell}
        inside = rows
        if parents:
            a, b = _cell(last)
            fits = a.isin([p[0] for p in parents]) if last <= 64 else F.lit(False)
            if last > 64:
                for p in parents:
                    fits = fits | ((a == p[0]) & (b == p[1]))
            inside = rows.where(fits)
        a, b = _cell(depth)
        sums = inside.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("size").alias("bytes")).collect()
        cells = sorted(((r["a"], r["b"]), r["bytes"]) for r in sums)
        open_cells = {}
        for i, (parent, start) in below.items():
            target = i * total // shards
            own = [c for c in cells if parent is None or _inside(c[0], depth, parent, last)]
            ends = list(accumulate((size for _, size in own), initial=start))
            at = next(k for k in range(len(own)) if ends[k + 1] >= target)
            cell, lo, hi = own[at][0], ends[at], ends[at + 1]
            miss = min(target - lo, hi - target)
            if miss <= allowed or depth == DEPTHS[-1]:
                settled[i] = _low(cell, depth) if target - lo == miss else _past(cell, depth)
            else:
                open_cells[i] = (cell, lo)
        below, last = open_cells, depth
    return [settled[i] for i in sorted(settled)]


def _inside(cell: Key, depth: int, parent: Key, parent_depth: int) -> bool:
    low = _low(cell, depth)
    return _low(parent, parent_depth) <= low < _past(parent, parent_depth)


def shard_of(splitters: list[Key]) -> Column:
    """Number of splitters at or below a row's key."""
    shard = F.lit(0)
    for a, b in splitters:
        if a >= 1 << 63:
            continue
        a_, b_ = F.lit(a).cast("long"), F.lit(b).cast("long")
        at = (F.col("_sh_a") > a_) | ((F.col("_sh_a") == a_) & (F.col("_sh_b") >= b_))
        shard = shard + at.cast("int")
    return shard


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``, the row's number in its shard."""
    rows = keyed(docs, key, text)
    narrow = materialize(rows.select("size", "_sh_a", "_sh_b"), "shard-keys")
    splitters = find_splitters(narrow, shards, tolerance)
    buckets = max(1, narrow.count() // (shards * BUCKET_ROWS))
    place = (shard_of(splitters).alias("shard"), F.pmod("_sh_b", F.lit(buckets)).alias("_sh_bucket"))
    counts = narrow.select(*place).groupBy("shard", "_sh_bucket").count()
    before = Window.partitionBy("shard").orderBy("_sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias("_sh_shard"), F.col("_sh_bucket").alias("_sh_at"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_sh_start"),
    )
    within = Window.partitionBy("shard", "_sh_bucket").orderBy("_sh_a", "_sh_b")
    numbered = rows.select("*", *place).withColumn("_sh_row", F.row_number().over(within))
    out = numbered.join(
        starts, (numbered["shard"] == starts["_sh_shard"]) & (numbered["_sh_bucket"] == starts["_sh_at"])
    )
    slot = F.col("_sh_start") + F.col("_sh_row") - F.lit(1)
    return out.withColumn("slot", slot.cast("long")).select(*docs_columns(rows), "shard", "slot")


def docs_columns(rows: DataFrame) -> list[str]:
    return [f"`{c}`" for c in rows.columns if c not in ("_sh_a", "_sh_b")]


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder per shard, each in several files."""
    shard_documents(docs, **options).write.partitionBy("shard").parquet(path)
