"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])
SYLLABLES = {"en": "the and ing ly th er on re".split(), "de": "sch ung keit ein ü ß ver cht".split(), "fr": "é eau oui ment que è ç tion".split()}
SHARED = "a line that very many of these documents hold in common"


def sentence(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words)) + "."


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Ordinary documents, one hot source, shared lines, exact and near copies."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text = "\n".join(sentence(rng, lang, rng.randint(8, 30)) for _ in range(rng.randint(1, 5)))
        if i % 4 == 0:
            text += "\n" + SHARED + ("  " if i % 8 else "").upper() + "\n" + SHARED
        if i % 10 == 9:
            text = out[-3][1]
        out.append((i, text, lang, "big" if i % 3 else f"s{i % 5}", len(text)))
    return out


AWKWARD = [
    (1000, None, None, None, None), (1001, "", "en", "big", 0), (1002, " \t\n\x0b\f\r ", "de", "big", 7),
    (1003, "12 34 ## !!", None, "big", 11), (1004, "x" * 70_000, "en", None, 70_000), (1005, "one two", "fr", "big", 7),
    (1006, "café \U0001f600   \x1c 中文\n\n\nZ", "fr", "big", 20), (1007, "tie tie", "en", "t", 7),
    (1008, "tie tie", "en", "t", 7), (1008, "tie tie", "en", "t", 7), (None, "no id here", "en", "big", 10),
    (1009, ("word " * 30_000).strip() + "\nlast", "en", "big", 150_000),
]


def frame(spark, data):
    return spark.createDataFrame(data, DOCS)
