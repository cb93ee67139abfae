"""Pairs of texts whose sets of 5-word shingles agree to at least 0.8, and their components.

Texts with equal sets are one row from then on. SimHash (``simhash.py``: fingerprints within 3 bits, found by
Hamming balls in two tables) names the first candidates. What 3 bits leave shares one of 24 bands of six
MinHash values each: a pair at exactly 0.8 shares one with probability 0.999, closer pairs almost surely. Every
candidate is then verified on its shingles, so a link is never an estimate; pairs that SimHash joined are not made again.

Pairs of a band's bucket are made at once only in small buckets. In a larger one all members are first
compared with one of them, then with 4, 16 and so on chosen by a hash, until the bucket is one component
or every pair was compared; pairs inside one component are never made. A large
group above 0.8 costs a few comparisons per member; one that shares a bucket but stays below costs up to
the square of its size.

Edge cases: words are lower-cased and end at white space; fewer than five words are one shingle; texts
without words, null texts too, have the empty set and equal each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm import simhash
from driftline.llm.components import connected_components
from driftline.session import materialize

WORD = re.compile(rb"[^ \t-\r]+")
SHINGLE = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS = 24, 6
SEED = 42
#: Buckets up to this size are compared pair by pair at once.
PAIRED = 8
#: Chosen texts up to this number are found by a broadcast.
BROADCAST_ROWS = 500_000
#: Shingles hashed by all MinHash functions at once.
HASHED = 1 << 12
#: Rows of texts that a Python worker holds at once, and texts whose shingles it keeps.
BATCH_ROWS, KEPT = 256, 64
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

_drawn = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FACTORS, _SHIFTS = _drawn[0] * np.uint64(2) + np.uint64(1), _drawn[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    found = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in found], dtype=np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One (signed) value for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), HASHED):
        part = hashes[start:start + HASHED, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    values = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(values, dtype=np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets agree to the least similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * common >= OVER * (len(a) + len(b) - common)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python in small batches; a default batch of long ones would fill a worker."""
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            found = shingles(t)
            rows.append((xxhash.xxh64_intdigest(found.tobytes(), SEED), len(found), simhash.fingerprint(t), bands(found)))
        out = pd.DataFrame(rows, columns=["sid", "size", "fp", "bands"])
        for c in ("sid", "fp"):
            out[c] = np.array([r[0 if c == "sid" else 2] for r in rows], dtype=np.uint64).view(np.int64)
        yield out


def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    known: dict[str | None, np.ndarray] = {}

    def of(text: str | None) -> np.ndarray:
        if text not in known:
            if len(known) >= KEPT:
                del known[next(iter(known))]
            known[text] = shingles(text)
        return known[text]

    return pd.Series([similar(of(a), of(b)) for a, b in zip(left, right)], dtype=bool)


def _exchanged(df: DataFrame, name: str) -> DataFrame:
    """The sum with 0 hides the partitioning, so that a join can split a key with very many rows."""
    return df.withColumn(name, F.col(name) + F.lit(0).cast("long"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that are similar."""
    left = texts.select(F.col("sid").alias("a"), F.col("text").alias("_a"))
    right = texts.select(F.col("sid").alias("b"), F.col("text").alias("_b"))
    both = _exchanged(pairs, "a").join(left, "a").join(right, "b")
    with _small_batches(pairs.sparkSession):
        return materialize(both.where(F.pandas_udf(_similar, "boolean")("_a", "_b")).select("a", "b"), "near-links")


def _pairs(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
    """Distinct pairs of members that share a bucket, in different components and of sizes that allow a link."""
    a = left.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("sid", "size", "root")])
    b = right.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("sid", "size", "root")])
    apart = F.col("sid_a") < F.col("sid_b") if ordered else F.col("sid_a") != F.col("sid_b")
    fits = UNDER * F.least("size_a", "size_b") >= OVER * F.greatest("size_a", "size_b")
    both = b.join(a, "bucket").where(apart & fits & (F.col("root_a") != F.col("root_b")))
    # A member is one of few on side a only, so that side b keeps the pairs spread.
    return materialize(both.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct(), "near-pairs")


def _with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("sid"))
    joined = members.join(roots, members["sid"] == roots["node"], "left")
    return joined.withColumn("root", F.coalesce("root", "sid")).drop("node")


def _stars(roots: DataFrame) -> DataFrame:
    """One link per node to its root: the same components in fewer links, which need no further round."""
    return roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of buckets with several components."""
    spread = members.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi")
    return materialize(members.join(_exchanged(spread.select("bucket"), "bucket"), "bucket", "left_semi"), "near-members")


def _alike(prints: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash among the sets of ``prints`` (sid, fp): every set with one of its fingerprint,
    and one set each of any two fingerprints that a link of their Hamming balls joins."""
    sets = materialize(prints.select("sid", "fp").distinct(), "near-fps")
    firsts = materialize(sets.groupBy("fp").agg(F.min("sid").alias("first")), "near-firsts")
    equal = sets.join(_exchanged(firsts, "fp"), "fp").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    left, right = (firsts.select(F.col("fp").alias(f"_{x}"), F.col("first").alias(x)) for x in "ab")
    links = materialize(simhash.near_links(firsts.select("fp")).toDF("_a", "_b"), "near-balls")
    both = _exchanged(_exchanged(links, "_a"), "_b").join(left, "_a").join(right, "_b").select("a", "b")
    pairs = equal.union(both).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(pairs.distinct(), "near-alike")


def near_links(sets: DataFrame, texts_of, alike: DataFrame, paired: int = PAIRED) -> DataFrame | None:
    """Links (a, b) among the sets (sid, size, bands), enough to have all components; None without any
    candidate. ``texts_of`` gives (sid, text) for a table of sids; the pairs ``alike`` are verified first."""
    cells = sets.select("sid", "size", F.explode("bands").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(cells.join(_exchanged(shared, "bucket"), "bucket"), "near-members")
    wanted = members.select("sid").union(alike.select("a")).union(alike.select("b")).distinct()
    if members.isEmpty() and alike.isEmpty():
        return None
    texts = materialize(texts_of(wanted), "near-texts")
    links = _verified(alike, texts)
    place = F.shiftrightunsigned(F.xxhash64("sid"), 24).cast("double") / float(1 << 40)
    roots = connected_components(links)
    small = materialize(_with_roots(members.where(F.col("n") <= paired), roots), "near-members")
    links = _stars(roots).unionByName(_verified(_pairs(small, small, ordered=True), texts))
    large = members.where(F.col("n") > paired).withColumn("place", place)
    most = large.agg(F.max("n")).first()[0] or 0
    hubs, last = 0, 0
    while last < most:
        roots = connected_components(links)
        links = _stars(roots)
        large = _unsettled(_with_roots(large.drop("root"), roots))
        if large.isEmpty():
            break
        if not hubs:
            first = large.groupBy("bucket").agg(F.min_by(F.struct("sid", "size", "root"), "place").alias("_h"))
            left, hubs = first.select("bucket", "_h.*"), 1
            pairs = _pairs(left, large, ordered=False)
        else:
            # The chosen grow; those chosen before were compared with all.
            hubs *= 4
            rank = F.col("place") * F.col("n")
            rest = large.where(rank >= last)
            # A whole bucket is chosen at the end, when the number reaches its size.
            pairs = _pairs(rest.where(rank < hubs), rest, ordered=False)
            last = hubs
        links = links.unionByName(_verified(pairs, texts))
    return links


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _key, sid, size, bands), one per row of ``docs``, and the component ``root`` of every set
    (sid, least, root). ``_key`` is a hash of id and text."""
    key = F.xxhash64("doc_id", "text")
    sketch = F.pandas_udf(_sketch, "sid long, size long, fp long, bands array<long>")
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("_key"), sketch("text").alias("_s"))
    with _small_batches(docs.sparkSession):
        prints = materialize(prints.select("doc_id", "_key", "_s.*"), "near-prints")
    found = prints.groupBy("sid").agg(
        F.min("doc_id").alias("least"), F.min("_key").alias("_key"), F.first("size").alias("size")
    )
    found = materialize(found, "near-sets")
    one = prints.join(found.select(F.col("sid").alias("_sid"), F.col("_key").alias("_k")), (F.col("sid") == F.col("_sid")) & (F.col("_key") == F.col("_k")))
    sets = one.select("sid", "size", "bands").dropDuplicates(["sid"])

    def texts_of(sids: DataFrame) -> DataFrame:
        wanted = materialize(found.join(sids, "sid").select("sid", "_key"), "near-wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        return docs.select(key.alias("_key"), "text").join(wanted, "_key").select("sid", "text").dropDuplicates(["sid"])

    links = near_links(sets, texts_of, _alike(prints))
    roots = None if links is None else connected_components(links)
    return prints, materialize(_with_roots(found.select("sid", "least"), roots), "near-rooted")


def near_classes(docs: DataFrame) -> DataFrame:
    """One row (doc_id, component_id) per row of ``docs``; a component is named by its smallest doc_id."""
    prints, rooted = _rooted(docs)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(_exchanged(named, "root"), "root").select(F.col("sid").alias("_sid"), "component_id")
    classes = materialize(classes, "near-classes")
    return prints.join(classes, prints["sid"] == classes["_sid"]).select("doc_id", "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), among texts of one
    id that of the smallest hash, among repeated rows that whose other columns hash smallest.

    Rows are matched by id and text, so an id that stands for several unlinked texts keeps all of them,
    and rows without an id are told apart by their texts."""
    prints, rooted = _rooted(docs)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_key")
    firsts = prints.groupBy("sid").agg(F.min(place).alias("_c"))
    chosen = firsts.join(rooted.select("sid", "root"), "sid").groupBy("root").agg(F.min("_c").alias("_c"))
    repeated = prints.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key", F.lit(True).alias("_sd_often"))
    chosen = chosen.select(F.col("_c.doc_id").alias("_sd_id"), F.col("_c._key").alias("_key")).join(repeated, "_key", "left")
    chosen = materialize(chosen.withColumnRenamed("_key", "_sd_key"), "near-chosen")
    same = docs["doc_id"].eqNullSafe(F.col("_sd_id")) & (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("_sd_key"))
    out = docs.join(chosen.where("_sd_often is null"), same, "left_semi")
    often = chosen.where("_sd_often")
    if not often.isEmpty():
        order = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns))
        again = docs.join(often, same, "left_semi").withColumn("_sd_rank", F.row_number().over(order))
        out = out.unionByName(again.where("_sd_rank = 1").drop("_sd_rank"))
    return out
