"""Token counts of documents from counts of their distinct pre-tokens.

A sentence-piece merge never joins a character to a blank after it, because no piece of the vocabulary holds
such a pair; nor does any piece join a line break to a neighbour. ``load`` proves both from the vocabulary. So
a text falls into pre-tokens (blanks with the word after them, and runs of line breaks) whose merges do not
affect each other, and its tokens are the sum over its pre-tokens.

1. Distinct pre-tokens of all texts, with the number of documents that hold each: counted in each batch, then
   by a map-side combined aggregate.
2. Each distinct pre-token is encoded once by the library; only the number of pieces is kept.
3. Every document's pre-tokens are counted in its own row. The ``COMMON_TOKENS`` or fewer held by most documents,
   long ones by their hash, are matched where the document is read; a pre-token of most documents is thus no hot key. The others
   go through a join on the pre-token and are summed per document.

Ids are never made for documents. Edge cases: null and empty texts have no tokens; blanks-only texts,
control characters, special strings and the vocabulary's blank mark in a text count as the library counts
them; a very long word is one pre-token. Rows that repeat an id, and rows without one, each get their own count. An
empty table gives no rows. Columns other than id and text are not returned, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

MARK = "▁"
#: A line break is one byte piece whatever surrounds it.
BREAK = "\n"
COMMON_TOKENS = 200_000
#: Longer pre-tokens are looked up by their hash.
LONG = 64
#: Classes of counts per power of two.
STEPS = 8
#: Distinct pre-tokens a task gathers before it hands them on.
GATHER = 200_000
LIMIT = 4096
PRE_TOKEN = re.compile(f"[ {MARK}]+[^ {MARK}{BREAK}]*|[^ {MARK}{BREAK}]+|{BREAK}+")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary file, given to tasks as its bytes."""

    model: bytes

    def processor(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)


def load(path: str) -> Pieces:
    """Read a vocabulary and prove that pre-tokens are independent under it."""
    with open(path, "rb") as f:
        pieces = Pieces(f.read())
    sp = pieces.processor()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if re.search(f"[^{MARK}]{MARK}", piece) or BREAK in piece:
            raise ValueError(f"piece {i} crosses pre-tokens: {piece!r}")
    probes = ("a", " a  b ", "a\nb", "\n", f"x {MARK}y", "ﬁ ①")
    if any(len(sp.encode(p)) != sum(count_pieces(sp, pre_tokens(p))) for p in probes):
        raise ValueError("the vocabulary rewrites texts before it splits them")
    return pieces


def pre_tokens(text: str | None) -> list[str]:
    """Pre-tokens of a text in order; the blank that the library puts before a text is part of the first."""
    return PRE_TOKEN.findall(" " + text) if text else []


def count_pieces(sp: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[int]:
    """Pieces of each pre-token. After a line break the library adds no blank: those two pieces are taken off."""
    return [len(ids) - 2 for ids in sp.encode([BREAK + w for w in words], num_threads=1)] if words else []


def distinct_pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, held): every pre-token and the number of documents that hold it."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch["text"]:
                seen.update(set(pre_tokens(value)))
                if len(seen) >= GATHER:
                    yield _counted(seen)
                    seen.clear()
        if seen:
            yield _counted(seen)

    words = docs.select(F.col(f"`{text}`").alias("text")).mapInPandas(gather, "word string, held long")
    return words.groupBy("word").agg(F.sum("held").alias("held"))


def _counted(seen: Counter[str]) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "held": pd.Series(list(seen.values()), dtype="int64")})


def piece_counts(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` with the number of pieces of each, worked out once per word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = pieces.processor()
        for batch in batches:
            yield batch.assign(pieces=count_pieces(sp, list(batch["word"])))

    return words.mapInPandas(count, "word string, held long, pieces long")


def short(word: str) -> str:
    """The word, or where it is long a break and its hash: no pre-token looks like that."""
    return word if len(word) <= LONG else BREAK + hashlib.sha256(word.encode()).hexdigest()


def common_pre_tokens(counts: DataFrame, most: int = COMMON_TOKENS) -> dict[str, int]:
    """Pieces of the pre-tokens that many documents hold, by their short form: at most ``most``."""
    # Counts fall into at most 64 * STEPS classes by their logarithm; whole classes are taken from the top.
    class_of = F.floor(F.log2("held") * STEPS)
    classes = counts.groupBy(class_of.alias("class")).count().collect()
    room, least = most, None
    for row in sorted(classes, key=lambda r: -r["class"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["class"]
    if least is None:
        return {}
    name = F.when(F.char_length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit(BREAK), F.sha2("word", 256)))
    often = counts.where(class_of >= least)
    return {r["name"]: r["pieces"] for r in often.select(name.alias("name"), "pieces").collect()}


def count_tokens(
    docs: DataFrame, pieces: Pieces, limit: int = LIMIT, key: str = "doc_id", text: str = "text",
    most_common: int = COMMON_TOKENS,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    counts = materialize(piece_counts(distinct_pre_tokens(narrow), pieces), "piece-counts")
    common = common_pre_tokens(counts, most_common)

    @F.pandas_udf("n_tokens long, words array<string>, numbers array<long>")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums, words, numbers = [], [], []
            for value in batch:
                total, rest = 0, {}
                for word, n in Counter(pre_tokens(value)).items():
                    in_word = common.get(short(word))
                    if in_word is None:
                        rest[word] = n
                    else:
                        total += n * in_word
                sums.append(total)
                words.append(list(rest))
                numbers.append(list(rest.values()))
            yield pd.DataFrame({"n_tokens": sums, "words": words, "numbers": numbers})

    n_bytes = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    partial = narrow.select("key", n_bytes.alias("n_bytes"), known("text").alias("k")).select("key", "n_bytes", "k.*")
    # Written, so that the row numbers stay as they are when a task is repeated.
    partial = materialize(partial.withColumn("row", F.monotonically_increasing_id()), "token-sums")
    pairs = partial.select("row", F.explode(F.arrays_zip("words", "numbers")).alias("p")).select("row", "p.words", "p.numbers")
    rest = pairs.join(counts.select("word", "pieces"), F.col("words") == F.col("word"))
    rest = rest.groupBy("row").agg(F.sum(F.col("numbers") * F.col("pieces")).alias("more"))
    n_tokens = F.col("n_tokens") + F.coalesce("more", F.lit(0))
    return partial.drop("words", "numbers").join(rest, "row", "left").select(
        F.col("key").alias(key), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
