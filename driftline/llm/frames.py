"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as white space between words and around lines: blank and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\f\r"


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in taken]
    return df if len(kept) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in kept])


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only. Plain ``lower`` is the same where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def with_text(docs: DataFrame, new_text: Column) -> DataFrame:
    """Replace ``text``; ``n_chars``, where present, follows it."""
    out = docs.withColumn("text", new_text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
