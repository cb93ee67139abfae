"""Merkle manifest of a dataset as append logs in postorder.

Leaves are hashes of rows. Each tree (one per source) takes its leaves in key order; every run of 16 nodes of
a level becomes a node of the next, until one is left. The subroots, in the order of their sources, are the leaves of
one more tree, whose last node is the root of the dataset.

**Builders.** Leaves are numbered by a range sort with running counts, so a source that holds a third of all rows is
many tasks. A builder owns an aligned block, the 16**3 leaves below one node of level 3, and appends the block's
nodes in the order in which they are completed (postorder: a node follows its last child). A block is a
row of the log: (tree, tier, block, digests). Node 3 levels up goes on to the next tier, which
builds in the same way over blocks of 16**3 of those nodes, until each tree is one node.

**Positions.** A node's place needs no index and no pointers: of the nodes of a tree, those below it or
level with it are completed if they begin before its end, those above it if they end before its last leaf. So
``position`` counts both from ``n`` alone; a tree of ``n`` leaves takes ``size(n)`` places. The same formula, with the levels of one
tier, gives the place within a block. Siblings for a proof are addressed by it.

**Proofs.** Top down, each tier joins its blocks with the proofs of the nodes above them, a few kB per block;
a leaf's siblings are read from its own block. Nothing is collected: the driver sees the number of tiers only.

Edge cases: a null or empty field is encoded as such; rows without a source form a tree of their own, before
the others; rows without an id come first in their tree; rows that repeat an id are ordered by their leaf, and
equal rows are leaves of their own. A tree of one leaf has that leaf as its subroot, and a dataset of one tree that subroot
as its root; then there may be no siblings, and the proof is the hash of nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.frames import ascii_lower
from driftline.operators.ordered import small_side
from driftline.session import materialize

FAN = 16
#: Levels that one builder completes; a block has ``FAN ** TIER`` leaves.
TIER = 3
BLOCK = FAN**TIER
#: Fixed value: fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "tree string, tier int, block long, n long, digests array<string>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def position(level: int, index: int, n: int, top: int) -> int:
    """Postorder place of a node among the nodes of levels 0 to ``top`` of a tree of ``n`` leaves."""
    end = min((index + 1) * FAN**level, n)
    below = sum(-(-end // FAN**m) for m in range(level + 1))
    above = sum((end - 1) // FAN**m for m in range(level + 1, top + 1))
    return below + above - 1


def size(n: int, top: int | None = None) -> int:
    """Nodes of levels 0 to ``top`` of a tree of ``n`` leaves."""
    return sum(-(-n // FAN**m) for m in range((height(n) if top is None else top) + 1))


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hash of named values, each ``-`` if null, else its length in bytes, a colon and the value."""
    parts = []
    for value in fields.values():
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tree_key(source: Column) -> Column:
    """Trees sort as their sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def number_leaves(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, key, leaf, ...) with ``n``, the leaves of the tree, and ``index`` in it.

    Rows are dealt by ranges and written in order, so numbers do not change when a task is repeated. Ranges
    go on into a running number, so that many equal rows can be cut as well.
    """
    drawn = materialize(leaves.withColumn("draw", F.monotonically_increasing_id()), "leaves")
    order = ["tree", F.asc_nulls_first("key"), "leaf", "draw"]
    dealt = drawn.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(dealt.drop("draw"), "ordered-leaves").withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"), "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    joined = placed.join(small_side(starts), (F.col("tree") == F.col("_tree")) & (F.col("part") == F.col("_part")))
    index = F.col("place") - F.col("first") + F.col("start")
    return joined.withColumn("index", index).drop("place", "part", "_tree", "_part", "first", "start")


def block_levels(n: int, tier: int) -> int:
    """Levels that the blocks of a tier complete above their own leaves: as many as the tree still has, up to ``TIER``."""
    return min(TIER, height(n) - TIER * tier)


class Block:
    """An aligned block: its nodes in the order of completion, its last node last."""

    def __init__(self, levels: int, count: int, digests: list[str]):
        self.levels, self.count, self.digests = levels, count, digests
        self._runs: dict[tuple[int, int], list[str]] = {}

    @classmethod
    def build(cls, leaves: list[str], levels: int) -> Block:
        """Append each leaf, and each node as soon as its last child is there."""
        log: list[str] = []
        pending: list[list[str]] = [[] for _ in range(levels + 1)]
        for at, node in enumerate(leaves, start=1):
            level, last = 0, at == len(leaves)
            while True:
                log.append(node)
                pending[level].append(node)
                if level == levels or not (last or len(pending[level]) == FAN):
                    break
                node, pending[level] = digest(pending[level]), []
                level += 1
        return cls(levels, len(leaves), log)

    @property
    def root(self) -> str:
        return self.digests[-1]

    def run(self, level: int, index: int) -> tuple[list[str], int]:
        """The run of nodes that hold the node, and the node's place in it."""
        first = index - index % FAN
        nodes = self._runs.get((level, first))
        if nodes is None:
            last = min(first + FAN, -(-self.count // FAN**level))
            nodes = [self.digests[position(level, i, self.count, self.levels)] for i in range(first, last)]
            self._runs[level, first] = nodes
        return nodes, index - first

    def proof(self, leaf: int) -> list[tuple[list[str], int]]:
        """Runs on the way from a leaf of the block to its last node."""
        return [self.run(level, leaf // FAN**level) for level in range(self.levels)]


def fold(leaf: str, path: list[tuple[list[str], int]]) -> str:
    """The last node, worked out from a leaf and the siblings in ``path``."""
    for run, at in path:
        leaf = digest([*run[:at], leaf, *run[at + 1:]])
    return leaf


def siblings(path: list[tuple[list[str], int]]) -> list[str]:
    return [node for run, at in path for i, node in enumerate(run) if i != at]


def build_log(leaves: DataFrame) -> tuple[DataFrame, int]:
    """The log of all trees over (tree, index, n, leaf), one row per aligned block, and the number of tiers."""
    spark = leaves.sparkSession
    tallest = leaves.agg(F.max("n")).first()[0]
    if not tallest:
        return spark.createDataFrame([], SEGMENT), 0

    def build(tier: int):
        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("index")
            n, tree = int(group["n"].iloc[0]), group["tree"].iloc[0]
            block = Block.build(list(group["leaf"]), block_levels(n, tier))
            return pd.DataFrame({"tree": [tree], "tier": [tier], "block": [int(group["block"].iloc[0])], "n": [n], "digests": [block.digests]})

        return one

    log, nodes, tiers = None, leaves.select("tree", "index", "n", "leaf"), max(1, -(-height(tallest) // TIER))
    for tier in range(tiers):
        blocks = nodes.withColumn("block", F.floor(F.col("index") / BLOCK).cast("long")).groupBy("tree", "block")
        segments = materialize(blocks.applyInPandas(build(tier), SEGMENT), f"log-{tier}")
        log = segments if log is None else log.unionByName(segments)
        # A block whose tree has more levels hands its last node on; the next tier logs it as a leaf of its own.
        more = F.col("n") > BLOCK ** (tier + 1)
        nodes = segments.where(more).select("tree", F.col("block").alias("index"), "n", F.element_at("digests", -1).alias("leaf"))
    return log, tiers


def log_nodes(log: DataFrame) -> DataFrame:
    """(tree, level, index, position, digest): every node of every tree, with its place in the tree's log."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, tier, block, n, digests in batch[["tree", "tier", "block", "n", "digests"]].itertuples(index=False):
                rows, own = [], block_levels(n, tier)
                count = block_leaves(n, tier, block)
                # A last node that goes on is a leaf of the next tier.
                last = own if own < TIER or height(n) == TIER * (tier + 1) else own - 1
                for level in range(last + 1):
                    for i in range(-(-count // FAN**level)):
                        index = block * FAN ** (TIER - level) + i
                        at = position(TIER * tier + level, index, n, height(n))
                        rows.append((tree, TIER * tier + level, index, at, digests[position(level, i, count, own)]))
                yield pd.DataFrame(rows, columns=["tree", "level", "index", "position", "digest"])

    return log.mapInPandas(places, "tree string, level int, index long, position long, digest string")


def block_leaves(n: int, tier: int, block: int) -> int:
    """Leaves of a block of a tier: nodes of level ``TIER * tier`` that it covers."""
    return min(BLOCK, -(-n // BLOCK**tier) - block * BLOCK)


def subroots(log: DataFrame) -> DataFrame:
    """(tree, subroot): the last node of every tree."""
    highest = F.col("n") <= F.pow(F.lit(float(BLOCK)), F.col("tier") + 1)
    return log.where(highest).select("tree", F.element_at("digests", -1).alias("subroot"))


PATH = "array<struct<run:array<string>,at:int>>"
CARRIED = f"tree string, block long, above {PATH}, subroot string, root string"


def _as_path(value) -> list[tuple[list[str], int]]:
    return [(list(step["run"]), int(step["at"])) for step in value]


def _as_rows(path: list[tuple[list[str], int]]) -> list[dict]:
    return [{"run": run, "at": at} for run, at in path]


def paths_down(log: DataFrame, tiers: int, above: DataFrame) -> DataFrame:
    """Block rows of tier 0 with ``above``, the way from the block's last node to the root.

    ``above`` has (tree, above, subroot, root) for each tree: the way from its subroot. Ways come down tier by tier.
    """
    top = above.withColumn("block", F.lit(0).cast("long")).withColumnRenamed("tree", "_tree").withColumnRenamed("block", "_block")
    coming: DataFrame | None = None
    for tier in reversed(range(tiers)):
        segments = log.where(F.col("tier") == tier)
        highest = F.col("n") <= BLOCK ** (tier + 1)
        # Trees that end at this tier start from their subroot's way, the others from the tier above.
        starts = [segments.where(highest).join(top, F.col("tree") == F.col("_tree")).drop("_tree", "_block")]
        if coming is not None:
            renamed = coming.withColumnRenamed("tree", "_tree").withColumnRenamed("block", "_block")
            starts.append(
                segments.where(~highest).join(renamed, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")
            )
        here = starts[0] if len(starts) == 1 else starts[0].unionByName(starts[1])
        if tier == 0:
            return here

        def down(batches: Iterator[pd.DataFrame], tier: int = tier) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for tree, block, n, digests, way, subroot, root in batch[["tree", "block", "n", "digests", "above", "subroot", "root"]].itertuples(index=False):
                    count, way = block_leaves(n, tier, block), _as_path(way)
                    own = Block(block_levels(n, tier), count, list(digests))
                    leaves = iter(range(count))
                    while some := list(islice(leaves, 256)):
                        yield pd.DataFrame({
                            "tree": tree, "block": [block * BLOCK + i for i in some],
                            "above": [_as_rows(own.proof(i) + way) for i in some], "subroot": subroot, "root": root,
                        })

        coming = materialize(here.mapInPandas(down, CARRIED), f"ways-{tier}")
    raise AssertionError("no tier 0")


def prove(leaves: DataFrame, log: DataFrame, tiers: int, above: DataFrame) -> DataFrame:
    """For every leaf: its siblings up to the root, and the root worked out from them and ``other``.

    ``leaves`` has (tree, index, n, key, leaf, other); ``other`` is null where the leaf itself is folded.
    """
    blocks = paths_down(log, tiers, above).select(F.col("tree"), "block", "digests", "above", "subroot", "root")
    kind = leaves.schema["key"].dataType
    # As text, since pandas has no whole numbers beside nulls.
    rows = leaves.select("tree", "index", "n", F.col("key").cast("string").alias("key"), "leaf", "other")
    rows = rows.withColumn("block", F.floor(F.col("index") / BLOCK).cast("long"))

    def extract(group: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        n, block, segment = int(group["n"].iloc[0]), int(group["block"].iloc[0]), segment.iloc[0]
        own = Block(block_levels(n, 0), block_leaves(n, 0, block), list(segment["digests"]))
        above = _as_path(segment["above"])
        beyond = siblings(above)
        proofs, folded = [], []
        for index, leaf, other in zip(group["index"], group["leaf"], group["other"]):
            path = own.proof(int(index) - block * BLOCK)
            proofs.append(siblings(path) + beyond)
            folded.append(fold(leaf if other is None else other, path + above))
        out = group[["tree", "index", "key", "leaf"]].assign(
            subroot=segment["subroot"], root=segment["root"], proof_sha256=[digest(p) for p in proofs], folded_root=folded
        )
        return out

    cogrouped = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    found = cogrouped.applyInPandas(
        extract, "tree string, index long, key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )
    return found.withColumn("key", F.col("key").cast(kind))


def manifest(
    docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text",
    tampered: Column | None = None,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    Rows where ``tampered`` holds are verified with a changed text: A to Z in lower case."""
    column = lambda name: F.col(f"`{name}`")
    values = {name: column(name) for name in fields}
    changed = leaf_hash({**values, text: ascii_lower(column(text))})
    leaves = docs.select(
        tree_key(column(source)).alias("tree"), column(key).alias("key"), leaf_hash(values).alias("leaf"),
        (F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")).alias("other"),
    )
    numbered = materialize(number_leaves(leaves), "numbered-leaves")
    log, tiers = build_log(numbered)
    if not tiers:
        return docs.sparkSession.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, {RESULT}")
    tops = subroots(log)
    heads = number_leaves(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("subroot").alias("leaf")))
    heads = materialize(heads, "subroots")
    upper, upper_tiers = build_log(heads)
    root = subroots(upper).select(F.col("subroot").alias("root"))
    none = F.array().cast(PATH)
    start = root.select(F.lit("").alias("tree"), none.alias("above"), F.col("root").alias("subroot"), "root")
    ways = tree_ways(heads, paths_down(upper, upper_tiers, start))
    out = prove(numbered, log, tiers, materialize(ways, "tree-ways"))
    return out.select(
        F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def tree_ways(heads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(tree, above, subroot, root): the way from each subroot to the root."""

    def ways(group: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        n, block, segment = int(group["n"].iloc[0]), int(group["block"].iloc[0]), segment.iloc[0]
        own = Block(block_levels(n, 0), block_leaves(n, 0, block), list(segment["digests"]))
        above = _as_path(segment["above"])
        paths = [_as_rows(own.proof(int(i) - block * BLOCK) + above) for i in group["index"]]
        return pd.DataFrame({"tree": list(group["key"]), "above": paths, "subroot": list(group["leaf"]), "root": segment["root"]})

    rows = heads.withColumn("block", F.floor(F.col("index") / BLOCK).cast("long"))
    cogrouped = rows.groupBy("block").cogroup(blocks.select("block", "digests", "above", "root").groupBy("block"))
    return cogrouped.applyInPandas(ways, f"tree string, above {PATH}, subroot string, root string")
