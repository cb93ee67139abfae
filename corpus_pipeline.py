"""A training corpus from raw documents: each stage works on all that its predecessor kept.

The last stage returns token ids; the others return the columns of ``documents``. Further columns are
carried as far as the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, langid, line_dedup, mixing, near_copies
from driftline.llm.queries import VOCABULARY
from driftline.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Above this code length in its best language (of 8 bits a byte) a text is in none of them.
MAX_BITS = 6.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no learned language explains. ``lang`` stays as it
    was. Without any labelled text nothing is learned, and nothing rejected."""
    model = langid.fit(docs, ~langid.held_out(5, 0))
    if not model.languages:
        return docs
    found = langid.predict(docs, model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") <= MAX_BITS)
    return found.where(known).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; no document goes."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash first, then what its 3 bits leave."""
    return near_copies.keep_one_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their size; a document may come several times."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; ``restored`` says whether they decode to exactly that text."""
    vocabulary = bpe.load_vocabulary(public_tokenizers.path(VOCABULARY))
    out = bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN, decode=True)
    restored = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", "n_tokens", "tokens", restored.alias("restored"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]
#: Code lengths, string hashes and token merges are not SQL; tests compare with plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
