"""Quality by weak supervision: rules vote or abstain, and a label model weighs their votes.

Each rule looks at one property of the whole text and votes good, bad, or not at all. A pass over the
corpus counts how often each pattern of votes occurs (at most 3 ** rules patterns, combined
map-side), expectation-maximisation on these counts estimates how often each rule is right about
good and about bad documents, and every document gets the posterior probability that it is good. No
rule rejects alone; a few hard minimums (``base_failed``) come first.

Words are runs of characters other than blank and 0x09-0x0D. Edge cases: a null or empty text has no
words and fails the base; equal rows get equal results; ties at the threshold are kept; an empty
table gives an empty table and a model with even odds. Added columns replace those of their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.frames import without
from driftline.session import materialize

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?…\"'»«()-"
ENDINGS = tuple(".!?:;\"'»”…)")
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_ended_lines",
    "n_letter_words", "n_letters", "n_clean_words", "n_commonest",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``FEATURES`` for one text."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    duplicates = lines = ended = 0
    for line in text.split("\n"):
        bare = line.strip(" \t\x0b\f\r")
        if bare:
            lines += 1
            ended += bare.endswith(ENDINGS)
            duplicates += line in seen
            seen.add(line)
    counts = Counter(words)
    letter_words = letters = clean = 0
    for word, n in counts.items():
        own = len(word) if word.isalpha() else sum(map(str.isalpha, word))
        letters += own * n
        letter_words += n * (own > 0)
        clean += n * (own > 0 and (own == len(word) or word.strip(PUNCTUATION).isalpha()))
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words),
        lines, ended, letter_words, letters, clean, max(counts.values(), default=0),
    )


def repeated_words(words: list[str]) -> int:
    """How many words lie in a 3-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, until = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``FEATURES``, ``base_failed`` included."""
    docs = without(docs, *FEATURES, "base_failed")
    schema = ", ".join(f"{f} long" for f in FEATURES)

    @F.pandas_udf(schema)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=list(FEATURES), dtype="int64")

    out = docs.withColumn("_q", measured(F.col(text))).select(*[f"`{c}`" for c in docs.columns], "_q.*")
    few = F.col("n_words") < MIN_WORDS
    looped = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    return out.withColumn("base_failed", few | looped)


def _rule(value: Column, good: Column, bad: Column) -> Column:
    """1 votes good, 0 votes bad, -1 abstains; a null value abstains."""
    return F.when(value.isNull(), -1).when(good, 1).when(bad, 0).otherwise(-1)


def votes() -> dict[str, Column]:
    """The rules over ``FEATURES``."""
    words = F.col("n_words").cast("double")
    share = lambda c, of: F.try_divide(F.col(c).cast("double"), of)
    size = share("word_chars", words)
    symbols, worded = share("n_symbols", words), share("n_letter_words", words)
    letters, clean = share("n_letters", F.col("word_chars").cast("double")), share("n_clean_words", words)
    repeats, common = share("n_repeat_words", words), share("n_commonest", words)
    lines = F.col("n_text_lines").cast("double")
    duplicates, ended = share("n_dup_lines", lines), share("n_ended_lines", lines)
    return {
        "length": _rule(words, words >= 100, words < MIN_WORDS),
        "word_length": _rule(size, (size >= 3) & (size <= 10), (size < 2) | (size > 14)),
        "symbols": _rule(symbols, symbols <= 0.05, symbols > 0.2),
        "duplicate_lines": _rule(duplicates, duplicates <= 0.1, duplicates > 0.3),
        "repeated_words": _rule(repeats, repeats <= 0.15, repeats > 0.35),
        "line_ends": _rule(ended, ended >= 0.5, ended < 0.12),
        "letter_words": _rule(worded, worded >= 0.8, worded < 0.6),
        "letters": _rule(letters, letters >= 0.85, letters < 0.75),
        "clean_words": _rule(clean, clean >= 0.8, clean < 0.6),
        "commonest_word": _rule(common, common <= 0.15, common > 0.3),
    }


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and per rule the rates of right votes on good and on bad ones."""

    good: float
    right_if_good: tuple[float, ...]
    right_if_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log odds that a good vote and a bad vote add."""
        return [
            (math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.right_if_good, self.right_if_bad)
        ]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, close: float = 1e-10) -> LabelModel:
    """Expectation-maximisation over vote patterns (rows of 1, 0, -1) and how often each occurs.

    It starts with the documents against which no rule votes as the good ones. Rates of right votes stay within 0.55 and 0.999: a rule is taken
    to be better than chance, so the two classes cannot change places.
    """
    good_vote, bad_vote = patterns == 1, patterns == 0
    posterior = 0.95 * 0.3 ** bad_vote.sum(1)
    total = counts.sum()
    if not total:
        return LabelModel(0.5, (0.9,) * patterns.shape[1], (0.9,) * patterns.shape[1])
    for _ in range(rounds):
        p, q = counts * posterior, counts * (1 - posterior)
        good = np.clip(p.sum() / total, 0.01, 0.99)
        rate = lambda w, right, wrong: np.clip((w @ right + 0.9) / (w @ right + w @ wrong + 1.0), 0.55, 0.999)
        if_good, if_bad = rate(p, good_vote, bad_vote), rate(q, bad_vote, good_vote)
        odds = (
            np.log(good / (1 - good)) + good_vote @ np.log(if_good / (1 - if_bad)) + bad_vote @ np.log((1 - if_good) / if_bad)
        )
        new = 1 / (1 + np.exp(-odds))
        moved, posterior = np.abs(new - posterior).max(), new
        if moved < close:
            break
    return LabelModel(float(good), tuple(map(float, if_good)), tuple(map(float, if_bad)))


def fit_label_model(features: DataFrame) -> LabelModel:
    """The label model of all rows that pass the base."""
    rules = votes()
    seen = features.where(~F.col("base_failed")).select(*[v.alias(f"_v{i}") for i, v in enumerate(rules.values())])
    rows = seen.groupBy(*seen.columns).count().orderBy(*seen.columns).collect()
    table = np.array([tuple(r) for r in rows], dtype=np.int64).reshape(-1, len(rules) + 1)
    return fit(table[:, :-1], table[:, -1])


def posterior(model: LabelModel) -> Column:
    """Probability that a row with ``FEATURES`` is good."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for vote, (up, down) in zip(votes().values(), model.weights()):
        odds = odds + F.when(vote == 1, up).when(vote == 0, down).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def quality(docs: DataFrame, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Every row of ``docs`` without its text, with ``FEATURES``, ``base_failed``, ``posterior`` and ``kept``.

    The features are written once; fitting and scoring read them. Join the verdicts to texts by id.
    """
    measured = materialize(with_features(docs, text).drop(text), "quality")
    model = fit_label_model(measured)
    scored = without(measured, "posterior", "kept").withColumn("posterior", posterior(model))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
