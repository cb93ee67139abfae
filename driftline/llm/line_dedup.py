"""Line deduplication over a corpus, decided on hashes and returned as bitmaps.

Lines of at least ``min_chars`` code points (stripped, A-Z lower-cased) are reduced to a 128-bit
hash. Hashes are range-partitioned together with the document id and sorted by (hash, document,
position): the range bounds fall inside a hash that very many documents share, so such a line is
spread over tasks. One pass over that order marks the first occurrence in each document; counts of
documents and the largest document id per hash are combined before they meet. Lines of hashes in at
least ``min_docs`` documents lose all occurrences except those in the largest document id.

The result is one sparse bitmap per document that loses lines (64 lines a word, words without a
drop left out until the end), never text: texts cross one exchange, when the bitmaps are applied.

Edge cases: a null or empty text is one empty line; rows that share a doc_id are one document, and
their bitmaps are told apart by text; a null doc_id is one document that is smaller than all others;
an empty table gives an empty table; other columns are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.frames import BLANKS, ascii_lower, with_text, without
from driftline.session import materialize

MIN_CHARS = 40
MIN_DOCS = 5
#: Repeated lines are broadcast up to this many rows of 40 bytes; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def _text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per long line: 128-bit hash of its key, document, hash of the text, position."""
    lines = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"),
        F.posexplode(_text_lines(F.col("text"))).alias("pos", "line"),
    )
    keyed = lines.select("doc", "version", "pos", F.btrim(F.col("line"), F.lit(BLANKS)).alias("line"))
    keyed = keyed.where(F.char_length("line") >= min_chars)
    keyed = keyed.select("doc", "version", "pos", ascii_lower(F.col("line")).alias("line"))
    return keyed.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "doc", "version", "pos"
    )


def repeated_lines(occurrences: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes found in at least ``min_docs`` documents, with the largest document id that holds them."""
    spread = occurrences.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "version", "pos")
    within = Window.partitionBy("h1", "h2", "doc").orderBy("version", "pos")
    first = spread.withColumn("first", (F.row_number().over(within) == 1).cast("long"))
    stats = first.groupBy("h1", "h2").agg(F.sum("first").alias("docs"), F.max("doc").alias("keeper"))
    return stats.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (document, text) that loses lines: ``words`` with bit ``pos % 64`` of word
    ``pos / 64`` cleared for each dropped line, and ``n_dropped``. Words after the last drop are left out."""
    occurrences = line_occurrences(docs, min_chars)
    repeated = materialize(repeated_lines(occurrences, min_docs), "repeated-lines")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    dropped = occurrences.join(repeated, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    words = dropped.groupBy("doc", "version", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")
    )
    sparse = words.groupBy("doc", "version").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("sparse"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
    )
    full = F.lit(-1).cast("long")
    dense = F.aggregate(
        "sparse", F.array().cast("array<bigint>"),
        lambda acc, e: F.concat(acc, F.array_repeat(full, e["word"] - F.size(acc)), F.array(F.bitwise_not(e["bits"]))),
    )
    return sparse.select("doc", "version", dense.alias("words"), "n_dropped")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with the lines kept by their bitmaps, ``n_lines`` before dropping and ``n_dropped``."""
    docs = without(docs, "n_lines", "n_dropped").withColumn("_ld_version", F.xxhash64("text"))
    found = bitmaps.select(
        F.col("doc").alias("_ld_doc"), F.col("version").alias("_ld_key"), F.col("words").alias("_ld_words"),
        "n_dropped",
    )
    joined = docs.join(
        found, docs["doc_id"].eqNullSafe(found["_ld_doc"]) & (docs["_ld_version"] == found["_ld_key"]), "left"
    )
    lines = _text_lines(F.col("text"))
    one = F.lit(1).cast("long")
    kept = F.filter(lines, lambda _, i: F.coalesce(
        F.call_function("shiftright", F.get(F.col("_ld_words"), F.floor(i / 64).cast("int")), i % 64).bitwiseAND(one),
        one,
    ) == one)
    text = F.when(F.col("_ld_words").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("n_lines", F.size(lines).cast("long"))
    out = with_text(out, text)
    return out.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long"))).drop(
        "_ld_version", "_ld_doc", "_ld_key", "_ld_words"
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents without the repeated lines; see the module's text."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
