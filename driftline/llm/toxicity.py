"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two character strings counts the subsequences of three characters they share, each
weighed down by ``DECAY`` for every place it spans in either string, and is brought to unit length. A
word with letters put in or left out shares most of its subsequences with the word itself. Landmarks
are words of the training texts; a machine in the space they span is linear in the kernel values of
the landmarks, so it folds into one weight per subsequence, and scoring a word takes time in
proportion to its own subsequences, whatever the number of landmarks.

A text is the words in it: runs without white space, reduced to letters (case, accents and common
digit spellings folded, other characters left out); letters that stand alone in a row of three or more
are one word; words chained by other signs count joined and apart; long words are cut into overlapping windows. A logistic model turns the highest
margins among a text's words, and how many are above zero, into its probability.

Labels belong to texts, so training finds the words behind them: it starts from words far more
frequent in toxic texts, then takes in turns the most toxic word of each toxic text against the most
toxic words of clean ones (at most ``OTHERS`` drawn and ``HARD`` hardest ones). Variants of the learned words with a letter put in
are trained on beside them. It uses a bounded sample: whole labelled texts of about ``SAMPLE_BYTES``
(at most about ``SAMPLE_TEXTS`` texts) per class, chosen by a hash of the id, and of near copies (by one min-hash of their 3-word shingles) one.

Edge cases: a null or empty text, or one without letters, has no word and scores like one of only
harmless words; repeated rows score alike; without labelled texts of both classes every score is the
share of toxic labels (0 without any label). Added columns replace those of their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.frames import without
from driftline.session import materialize

DECAY = 0.75
WINDOW = 12
STRIDE = 3
LANDMARKS = 128
SAMPLE_BYTES = 8_000_000
SAMPLE_TEXTS = 20_000
ROWS_PER_ID = 8
ROUNDS = 4
SEED = 2
#: Learned words, the most frequent in toxic texts, of which variants with a letter put in are trained on, and variants per place.
VARIED, PER_PLACE = 300, 2
#: Variants together weigh as much as so many times the learned words.
VARIANT_WEIGHT = 2.0
#: Clean words drawn for each turn of training, and the hardest ones beside them.
OTHERS, HARD = 15_000, 5_000
#: Toxic texts that must hold a word before it counts as one of theirs.
SUPPORT = 3
THRESHOLD = 0.3
#: Margins below count as this.
FLOOR = -3.0
#: Words remembered per worker; beyond it the memory is emptied and filled anew.
REMEMBERED = 500_000
#: Words worked on together.
TOGETHER = 4096

#: Digits and signs that stand for letters.
SPELLINGS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
ALONE = re.compile(r"(?<!\S)\w(?:[^\S\n]\w){2,}(?!\S)")
SKIPPED, BREAK = 255, 254
#: What parts a word from its neighbour in a chain without blanks.
JOINT = re.compile(r"[^\w@]+|_+")


@cache
def alphabet() -> np.ndarray:
    """Symbol (0 to 31) of every code point; ``SKIPPED`` for what is left out, ``BREAK`` between words."""
    table = np.full(0x110000, SKIPPED, dtype=np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        base = SPELLINGS.get(base, base)
        if "a" <= base <= "z":
            table[c] = ord(base) - ord("a")
        elif base.isalnum():
            table[c] = 26 + c % 6
    for low, high in ((0x370, 0x2000), (0x2C00, 0xD800), (0xF900, 0xFB00), (0x20000, 0x30000)):
        table[low:high] = 26 + np.arange(low, high) % 6
    table[ord("\n")] = BREAK
    return table


def words_of(text: str | None) -> set[str]:
    """Distinct raw words of a text, lone letters joined."""
    text = (text or "").lower()
    words = set(text.split())
    words.update("".join(run.split()) for run in ALONE.findall(text))
    return words


def to_units(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as symbols: (units, WINDOW) padded matrix, the length of each unit, and its word's number.

    A word with other characters between its letters gives units of its joined form and of each part of three or more."""
    forms: list[str] = []
    word_of: list[int] = []
    for i, word in enumerate(words):
        parts = [p for p in JOINT.split(word) if p]
        forms += [word, *(p for p in parts if len(p) >= 3 and len(parts) > 1)]
        word_of += [i] * (len(forms) - len(word_of))
    data = "\n".join(forms) + "\n"
    symbols = alphabet()[np.frombuffer(data.encode("utf-32-le", "replace"), dtype=np.uint32)]
    symbols = symbols[symbols != SKIPPED]
    ends = np.flatnonzero(symbols == BREAK)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    pieces = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(forms)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[owner] + nth * STRIDE
    length = np.minimum(WINDOW, ends[owner] - first)
    at = np.minimum(first[:, None] + np.arange(WINDOW), len(symbols) - 1)
    units = symbols[at]
    units[np.arange(WINDOW) >= length[:, None]] = 0
    return units, length, np.array(word_of, dtype=np.int64)[owner]


def with_letters_put_in(units: np.ndarray, length: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """For every inner place of every unit ``PER_PLACE`` variants with some letter put in there."""
    made, sizes = [], []
    for unit, size in zip(units, length.tolist()):
        for place in range(1, size):
            for letter in rng.integers(0, 26, PER_PLACE):
                made.append(np.concatenate([unit[:place], [letter], unit[place:]])[:WINDOW])
                sizes.append(min(size + 1, WINDOW))
    return np.array(made, dtype=np.uint8).reshape(-1, WINDOW), np.array(sizes, dtype=np.int64)


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of three in a string of ``length``, and their weights."""
    places = np.array(list(combinations(range(length), 3)), dtype=np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] - 2.0)


def _features(units: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit-length feature vectors of strings of one length, sparse: row, subsequence, value."""
    places, weight = _triples(length)
    s = units.astype(np.int64)
    codes = s[:, places[:, 0]] << 10 | s[:, places[:, 1]] << 5 | s[:, places[:, 2]]
    codes |= np.arange(len(units))[:, None] << 15
    order = np.argsort(codes, axis=1, kind="stable")
    flat = np.take_along_axis(codes, order, axis=1).ravel()
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    value = np.add.reduceat(weight[order].ravel(), first)
    row, code = flat[first] >> 15, flat[first] & 0x7FFF
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(units)))
    return row, code, value / norm[row]


def margins(units: np.ndarray, length: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``weights`` (subsequences, columns) applied to the feature vector of every unit."""
    out = np.zeros((len(units), weights.shape[1]))
    for size in range(3, WINDOW + 1):
        own = np.flatnonzero(length == size)
        for start in range(0, len(own), TOGETHER):
            at = own[start:start + TOGETHER]
            row, code, value = _features(units[at], size)
            ends = np.flatnonzero(np.diff(row, prepend=-1))
            for column in range(weights.shape[1]):
                out[at, column] = np.add.reduceat(weights[code, column] * value, ends)
    return out


def dense(units: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Feature vectors as columns of a (subsequences, units) matrix."""
    out = np.zeros((1 << 15, len(units)))
    for i in range(len(units)):
        if length[i] >= 3:
            _, code, value = _features(units[i:i + 1], int(length[i]))
            out[code, i] = value
    return out


def train_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear support vector machine (squared hinge, Newton steps); the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        wrong = y * (x @ w) < 1
        a = x[wrong] * cost[wrong, None]
        new = np.linalg.solve(ridge + x[wrong].T @ a, a.T @ y[wrong])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def features(word_margins: np.ndarray) -> np.ndarray:
    """What a text's probability is made of: its three highest margins (distinct words), how many are
    above zero, and that number's share of the words."""
    kept = word_margins[word_margins > FLOOR]
    top = -np.sort(-np.concatenate([kept, [FLOOR] * 3]))[:3]
    above = float((kept > 0).sum())
    return np.array([*top, np.log1p(above), np.sqrt(above / max(1, len(kept))), 1.0])


def logistic(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic model (the last for the constant), each text counted ``weight`` times.

    A small ridge in units of the sample keeps them finite where the classes part cleanly."""
    w = np.zeros(x.shape[1])
    ridge = 0.01 * weight.sum() / len(weight) * np.eye(len(w))
    ridge[-1, -1] *= 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (toxic - p)) - ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Scorer:
    """Weights per subsequence and bias of the word machine, and the logistic model over a text."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.bias, self.curve = weights, bias, curve
        self.known: dict[str, float] = {}

    def _learn(self, words: list[str]) -> None:
        units, length, owner = to_units(words)
        unit_margins = np.where(length >= 3, margins(units, length, self.weights[:, None])[:, 0] + self.bias, -np.inf)
        best = np.full(len(words), -np.inf)
        np.maximum.at(best, owner, unit_margins)
        self.known.update(zip(words, best.tolist()))

    def features(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        new = list(words.difference(self.known))
        if new:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
                new = list(words)
            self._learn(new)
        return features(np.fromiter(map(self.known.__getitem__, words), float, len(words)))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.curve, -40, 40))))


def _constant(share: float) -> Scorer:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Scorer(np.zeros(1 << 15), 0.0, np.array([0, 0, 0, 0, 0, np.log(share / (1 - share))]))


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Scorer:
    """Scorer from labelled texts; ``weight`` is how many texts each one stands for."""
    if not len(texts) or toxic.all() or not toxic.any():
        return _constant(float(toxic.any()))
    rng = np.random.default_rng(SEED)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in sorted(words_of(t))], dtype=np.int64) for t in texts]
    units, length, word = to_units(list(vocabulary))
    text_of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    all_words = np.concatenate(docs)
    # Units that differ only in what is folded are one.
    _, kind = np.unique(np.hstack([units, length[:, None].astype(np.uint8)]), axis=0, return_inverse=True)
    example = np.zeros(kind.max() + 1, dtype=np.int64)
    example[kind] = np.arange(len(kind))
    units, length = units[example], length[example]
    first = np.searchsorted(word, np.arange(len(vocabulary) + 1))
    per_word = first[all_words + 1] - first[all_words]
    pair_text = np.repeat(text_of, per_word)
    pair_unit = kind[np.arange(len(pair_text)) - np.repeat(np.cumsum(per_word) - per_word, per_word) + np.repeat(first[all_words], per_word)]
    pairs = np.unique(pair_text << 32 | pair_unit)
    pair_text, pair_unit = pairs >> 32, pairs & 0xFFFFFFFF
    usable = length[pair_unit] >= 3
    pair_text, pair_unit = pair_text[usable], pair_unit[usable]
    in_toxic = np.bincount(pair_unit[toxic[pair_text]], minlength=len(units))
    in_clean = np.bincount(pair_unit[~toxic[pair_text]], minlength=len(units))
    # Seeds: more often in toxic texts than chance allows for any of so many units (binomial bound).
    share = toxic.mean()
    times = np.maximum(in_toxic + in_clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(in_toxic * np.log(in_toxic / times / share)) + np.nan_to_num(
            in_clean * np.log(in_clean / times / (1 - share))
        )
    gain = np.where(in_toxic > times * share, gain, 0.0)
    seeds = np.flatnonzero((gain >= np.log(len(units)) + 2) & (in_toxic >= 0.8 * times))
    if not len(seeds):
        seeds = np.argsort(-gain, kind="stable")[:1]
    clean = np.flatnonzero(in_clean > 0)
    positive, negative = seeds, rng.permutation(clean)[:OTHERS]
    weights, bias = np.zeros(1 << 15), 0.0
    for turn in range(ROUNDS):
        marks = _landmarks(positive, in_toxic, negative)
        phi = dense(units[marks], length[marks])
        values, vectors = np.linalg.eigh(phi.T @ phi)
        root = vectors[:, values > 1e-8] / np.sqrt(values[values > 1e-8])  # (K ** -1/2) of the landmarks
        train_at = np.concatenate([positive, negative])
        frequent = positive[np.argsort(-in_toxic[positive], kind="stable")][:VARIED]
        varied, varied_length = with_letters_put_in(units[frequent], length[frequent], rng)
        x = margins(np.vstack([units[train_at], varied]), np.concatenate([length[train_at], varied_length]), phi @ root)
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative)), np.ones(len(varied))])
        own_cost = 10.0 * max(1.0, len(negative) / len(positive) / 20)
        cost = np.where(y > 0, own_cost, 10.0)
        cost[len(train_at):] = own_cost * min(1.0, VARIANT_WEIGHT * len(positive) / max(1, len(varied)))
        w = train_machine(x, y, cost)
        weights, bias = phi @ (root @ w[:-1]), float(w[-1])
        score = margins(units, length, weights[:, None])[:, 0] + bias
        best = np.full(len(docs), -10.0)
        np.maximum.at(best, pair_text, score[pair_unit])
        # Witnesses of toxic texts, and the words of clean ones that look most like them.
        witness = np.unique(pair_unit[(score[pair_unit] >= best[pair_text]) & toxic[pair_text] & (best[pair_text] > 0)])
        witness = witness[in_clean[witness] <= in_toxic[witness] * (~toxic).sum() / toxic.sum() / 8]
        witness = witness[in_toxic[witness] >= SUPPORT]
        hard = clean[np.argsort(-score[clean], kind="stable")][:HARD]
        hard = hard[~np.isin(hard, witness)]
        positive = np.union1d(seeds, witness)
        negative = np.setdiff1d(np.union1d(hard, rng.permutation(clean)[:OTHERS]), positive)
    scorer = Scorer(weights, bias, np.zeros(6))
    scorer.curve = logistic(np.stack([scorer.features(t) for t in texts]), toxic, weight)
    scorer.known = {}
    return scorer


def _landmarks(positive: np.ndarray, in_toxic: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Three quarters words of toxic texts, the most frequent first, the rest others."""
    own = positive[np.argsort(-in_toxic[positive], kind="stable")][: 3 * LANDMARKS // 4]
    return np.concatenate([own, negative[: LANDMARKS - len(own)]])


def _shingle_key(text: str) -> int:
    """Least hash of the 3-word shingles: mostly the same for near copies."""
    words = text.split()
    shingles = map(" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [text]
    return min(map(zlib.crc32, (s.encode() for s in shingles)))


def sample(
    docs: DataFrame, labels: DataFrame, learnable: Column, sample_bytes: int, sample_texts: int = SAMPLE_TEXTS
) -> pd.DataFrame:
    """Whole labelled texts (text, toxic, weight): per class about ``sample_bytes`` and no more than
    about ``sample_texts``, of one id no more than ``ROWS_PER_ID`` rows. They are chosen on ids and sizes;
    only chosen texts move."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    own = docs.where(learnable & (F.octet_length("text") > 0))
    narrow = own.select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    labelled = materialize(narrow.join(marks, narrow["doc_id"] == marks["_id"]).select("_id", "bytes", "toxic"), "labelled")
    sizes = labelled.groupBy("toxic").agg(F.sum("bytes"), F.count("*")).collect()
    share = F.lit(0.0)
    for kind, size, texts in sizes:
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, sample_bytes / size, sample_texts / texts))).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("toxic"), F.col("_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.withColumn("share", share).where(u < F.col("share")).select("_id", "toxic", "share").distinct()
    rows = own.join(F.broadcast(chosen), own["doc_id"] == chosen["_id"]).select("doc_id", "text", "toxic", "share")
    # The limit by rank is applied before the exchange as well: an id that repeats brings few rows.
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= ROWS_PER_ID).drop("_rank")
    drawn = rows.toPandas().sort_values(["doc_id", "text"])
    drawn = drawn[~drawn["text"].map(_shingle_key).duplicated()]
    return pd.DataFrame({"text": drawn["text"], "toxic": drawn["toxic"] > 0, "weight": 1 / drawn["share"]})


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample_bytes: int = SAMPLE_BYTES) -> Scorer:
    """Scorer learned from the labelled rows of ``docs`` for which ``learnable`` holds."""
    rows = sample(docs, labels, learnable, sample_bytes)
    return train(rows["text"].tolist(), rows["toxic"].to_numpy(dtype=bool), rows["weight"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    docs = without(docs, "score", "predicted")
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = shipped.value
        for texts in batches:
            yield pd.Series([machine.score(t) for t in texts], dtype="float64")

    out = docs.withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
