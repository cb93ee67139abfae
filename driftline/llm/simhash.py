"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint bit is 1 if it is set in over half the XXH64 values (seed 42) of the text's 3-word
shingles, repeats included. Equal fingerprints are one row from then on. Fingerprints within 3 bits
differ by at most 1 bit in one of their two 32-bit segments, so each segment is a table: every
fingerprint is filed under its own segment value, and looks up all values in a Hamming ball of radius
1 around it. Of two values one bit apart exactly one has odd parity; only that one visits the other.
All matches of a table cell are verified on all 64 bits.

A cell never emits its pairs. Inside a cell, fingerprints are divided by four parts of the bits in
which they differ (two within 3 bits agree in one part) until few are left, and only a spanning
forest of the verified links leaves the task. Cells with very many fingerprints are divided the same
way before the exchange. Components of these links are those of all links.

Edge cases: texts without words have fingerprint zero and are linked like any other; a null text has
no words; one or two words are one shingle; rows with a null doc_id belong to their fingerprint's
component but do not name it; repeated rows share a component; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.components import connected_components
from driftline.llm.frames import without
from driftline.session import materialize

WORD = re.compile(rb"[^ \t-\r]+")
SHINGLE = 3
SEED = 42
RADIUS = 3
#: Cells with more owners than this are divided before the exchange.
CELL_ROWS = 50_000
#: Fingerprints compared with each other at once.
BLOCK = 512
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint of a text."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), COUNTED):
        part = hashes[start:start + COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return without(docs, name).withColumn(name, fingerprints(F.col(text)))


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _unite(parent: np.ndarray, pairs: np.ndarray) -> None:
    for a, b in pairs.tolist():
        a, b = _root(parent, a), _root(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)


def _link(values: np.ndarray, at: np.ndarray, parent: np.ndarray) -> None:
    """Unite all of ``values[at]`` within the radius. They are distinct."""
    if len(at) < 2:
        return
    own = values[at]
    if len(at) <= BLOCK:
        near = np.bitwise_count(own[:, None] ^ own[None, :]) <= RADIUS
        a, b = np.nonzero(np.triu(near, 1))
        _unite(parent, np.stack([at[a], at[b]], axis=1))
        return
    differing = np.bitwise_or.reduce(own ^ own[0])
    bits = [i for i in range(64) if int(differing) >> i & 1]
    if len(bits) <= RADIUS:
        _unite(parent, np.stack([at[:-1], at[1:]], axis=1))
        return
    for k in range(RADIUS + 1):
        mask = np.uint64(sum(1 << i for i in bits[k::RADIUS + 1]))
        part = own & mask
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(order, edges):
            _link(values, at[group], parent)


def spanning_links(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over distinct fingerprints that joins exactly those that links within them join."""
    parent = np.arange(len(values))
    _link(values, np.arange(len(values)), parent)
    roots = np.array([_root(parent, i) for i in range(len(values))])
    other = np.flatnonzero(roots != np.arange(len(values)))
    return values[other], values[roots[other]]


def _cells(distinct: DataFrame) -> DataFrame:
    """Rows (segment, cell, owner, fp): each fingerprint in its own cells, and as a visitor one bit away."""
    fp = F.col("fp")
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    own = distinct.select("fp", F.inline(F.array(
        F.struct(F.lit(0).alias("segment"), high.alias("value")), F.struct(F.lit(1).alias("segment"), low.alias("value")),
    )))
    flips = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    visits = F.when(F.bit_count("value") % 2 == 1, flips).otherwise(F.array().cast("array<bigint>"))
    steps = F.concat(F.array(F.lit(0).cast("long")), visits)
    return own.select("segment", "fp", "value", F.explode(steps).alias("step")).select(
        "segment", F.col("value").bitwiseXOR(F.col("step")).alias("cell"), (F.col("step") == 0).alias("owner"), "fp"
    )


def _divide_large(cells: DataFrame, cell_rows: int) -> DataFrame:
    """Adds ``part``: 0, or for cells around a value with very many owners each of four parts of the
    other segment, eight bits of it, in a row of its own."""
    owners = cells.where("owner").groupBy("segment", F.col("cell").alias("value")).count().where(F.col("count") > cell_rows)
    owners = materialize(owners.select("segment", "value"), "large-cells")
    if owners.isEmpty():
        return cells.withColumn("part", F.lit(0).cast("long"))
    around = F.concat(F.array(F.lit(0).cast("long")), F.array(*[F.lit(1 << i).cast("long") for i in range(32)]))
    large = owners.select("segment", F.explode(around).alias("step"), "value").select(
        "segment", F.col("value").bitwiseXOR(F.col("step")).alias("cell"), F.lit(True).alias("large")
    ).distinct()
    other = F.when(F.col("segment") == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
    parts = F.array(*[
        F.lit(1 + 256 * i) + F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)) for i in range(4)
    ])
    marked = cells.join(large, ["segment", "cell"], "left")
    return marked.withColumn(
        "part", F.explode(F.when(F.col("large"), parts).otherwise(F.array(F.lit(0).cast("long"))))
    ).drop("large")


def near_links(distinct: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) among the fingerprints ``fp``, enough to have all components."""
    cells = _divide_large(_cells(distinct), cell_rows)
    sorted_cells = cells.repartition("segment", "cell", "part").sortWithinPartitions("segment", "cell", "part")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            done, rest = _whole_cells(batch, last=False)
            if len(done):
                yield done
        if rest is not None:
            done, _ = _whole_cells(rest, last=True)
            if len(done):
                yield done

    return sorted_cells.mapInPandas(match, "a long, b long").distinct()


def _whole_cells(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """Links of all cells that end in ``rows``, and the rows of the cell that may go on."""
    same = np.ones(len(rows), dtype=bool)
    for c in ("segment", "cell", "part"):
        v = rows[c].to_numpy()
        same[1:] &= v[1:] == v[:-1]
    same[:1] = False
    starts = np.flatnonzero(~same)
    if last:
        ends = np.append(starts[1:], len(rows))
        rest = None
    else:
        ends = starts[1:]
        rest = rows.iloc[starts[-1]:] if len(starts) else None
        starts = starts[:-1]
    several = ends - starts > 1
    fps, owner = rows["fp"].to_numpy().view(np.uint64), rows["owner"].to_numpy(dtype=bool)
    found = []
    for s, e in zip(starts[several].tolist(), ends[several].tolist()):
        if owner[s:e].any():
            found.append(spanning_links(np.unique(fps[s:e])))
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
    b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}), rest


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (doc_id, fp, component_id) per row of ``docs``."""
    prints = materialize(with_fingerprints(docs.select(F.col(key).cast("long").alias("doc_id"), text), text).drop(text), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = connected_components(near_links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    classes = materialize(rooted.join(named, "root").select(F.col("fp").alias("_fp"), "component_id"), "classes")
    return prints.join(classes, prints["fp"] == classes["_fp"], "left").drop("_fp")
