"""Language identification by prediction by partial matching (PPM) on bytes.

Each language has a context tree over the bytes of its training texts: counts of the bytes that
followed every context of up to ``DEPTH`` bytes. With frozen counts, a byte costs exactly what PPM
(escape method C, with exclusion) would spend on it: it is coded in the longest context known to the
language, or an escape is paid there and the next shorter context is asked, without the bytes just
ruled out, down to a uniform code. A text belongs to the language that needs the fewest bits. Case is
folded first.

Counts are taken in Spark over a bounded sample: about ``SAMPLE_BYTES`` of each language, whole texts
chosen by a hash of their id. Costs of all byte strings that any language has seen are worked out
once and shipped as one table; only unseen strings walk the trees at scoring.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is everything where no
labelled text exists; long texts are scored in pieces that share context; equal texts score alike;
ties go to the language first in order. Rows with a null label are never learned from. Added
columns replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.frames import without
from driftline.llm.inttable import IntTable

DEPTH = 4
SAMPLE_BYTES = 2_000_000
UNKNOWN = "und"
#: Bytes scored at once.
CHUNK = 1 << 19
#: Letters only: number signs such as fractions and circled digits are none.
LETTER = regex.compile(r"\p{L}")
PAD = b"\0" * DEPTH


def grams(data: bytes) -> np.ndarray:
    """Each byte of ``data`` behind the ``DEPTH`` bytes before it, in one integer. The first ``DEPTH``
    bytes are context only."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(b) - DEPTH
    key = b[:n].copy()
    for k in range(1, DEPTH + 1):
        key <<= np.uint64(8)
        key |= b[k:k + n]
    return key


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Tree:
    """Frozen context tree of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """``keys``: distinct sorted grams with their counts."""
        self.log_n, self.grams, self.contexts = [], [], []
        self.fresh, self.after = [], []  # (bits of the whole count, bits of an escape) per context
        per_order = []
        for order in range(DEPTH + 1):
            short, inverse = np.unique(keys & _mask(order + 1), return_inverse=True)
            n = np.bincount(inverse, weights=counts)
            contexts, of = np.unique(short >> np.uint64(8), return_inverse=True)
            per_order.append((short, n, contexts, of))
            total, kinds = np.bincount(of, weights=n), np.bincount(of).astype(float)
            self.grams.append(short)
            self.log_n.append(np.log2(n))
            self.contexts.append(contexts)
            self.fresh.append(_bits(total, kinds))
            if order:
                # The next shorter context, without the bytes that this one has seen.
                lower, lower_n, lower_contexts, lower_of = per_order[order - 1]
                at, _ = _find(lower_contexts, contexts & _mask(order - 1))
                same, _ = _find(lower, short & _mask(order))
                left = np.bincount(lower_of, weights=lower_n)[at] - np.bincount(of, weights=lower_n[same])
                self.after.append(_bits(left, np.bincount(lower_of)[at] - kinds))
        self.uniform = np.log2(max(1, 256 - len(self.grams[0])))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of every gram."""
        cost = np.zeros(len(keys))
        alive = np.arange(len(keys))
        above = np.full(len(keys), -1)  # index of the context one longer, where known
        for order in range(DEPTH, -1, -1):
            own = keys[alive]
            context, seen = _find(self.contexts[order], (own >> np.uint64(8)) & _mask(order))
            gram, hit = _find(self.grams[order], own & _mask(order + 1))
            first = seen & (above[alive] < 0)
            total, escape = self.fresh[order][0][context], self.fresh[order][1][context]
            if order < DEPTH:
                longer = np.maximum(above[alive], 0)
                later = above[alive] >= 0
                total = np.where(later, self.after[order][0][longer], total)
                escape = np.where(later, self.after[order][1][longer], escape)
                seen = first | later
            cost[alive] += np.where(hit, total - self.log_n[order][gram], np.where(seen, escape, 0.0))
            above[alive] = np.where(seen, context, -1)
            alive = alive[~hit]
            if not len(alive):
                return cost
        cost[alive] += self.uniform
        return cost


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _bits(total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the whole count and of an escape; an escape is free where nothing is left."""
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(kinds > 0, np.log2(total + kinds), 0.0)
        escape = np.where(kinds > 0, whole - np.log2(kinds), 0.0)
    return whole, escape


class Model:
    """Trees of all languages, and the costs of every gram that one of them has seen."""

    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees
        known = np.unique(np.concatenate([t.grams[DEPTH] for t in trees])) if trees else np.empty(0, np.uint64)
        self.costs = np.stack([t.bits(known) for t in trees], axis=1).astype(np.float32) if trees else None
        self.row_of = IntTable(known, np.arange(len(known)))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """(grams, languages) code lengths."""
        row = self.row_of.get(keys)
        out = self.costs[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, inverse = np.unique(keys[new], return_inverse=True)
            out[new] = np.stack([t.bits(fresh) for t in self.trees], axis=1)[inverse]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) total bits; no text may be empty."""
        totals = np.zeros((len(texts), len(self.languages)))
        part, owners, held = [], [], 0

        def flush() -> None:
            keep = np.concatenate([np.arange(len(p)) >= DEPTH for p in part])[DEPTH:]
            bits = self.bits(grams(b"".join(part))[keep])
            starts = np.cumsum([0] + [len(p) - DEPTH for p in part[:-1]])
            np.add.at(totals, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))

        for i, text in enumerate(texts):
            padded = PAD + text
            for start in range(0, len(text), CHUNK):
                piece = padded[start:start + CHUNK + DEPTH]
                part.append(piece)
                owners.append(i)
                held += len(piece)
                if held >= CHUNK:
                    flush()
                    part, owners, held = [], [], 0
        if part:
            flush()
        return totals


def sample(docs: DataFrame, learnable: Column, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, list[str]]:
    """Learnable rows (text, lang), thinned by a hash of the id to about ``sample_bytes`` a language."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long"))).collect()}
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_bytes / size))).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("ppm"), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(u < share).select("text", "lang"), sorted(sizes)


def fit(docs: DataFrame, learnable: Column, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trees from the sampled rows of ``docs`` (doc_id, text, lang) for which ``learnable`` holds."""
    rows, languages = sample(docs, learnable, sample_bytes)
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                keys = np.concatenate([grams(PAD + t.lower().encode()) for t in texts])
                key, n = np.unique(keys, return_counts=True)
                yield pd.DataFrame({"lang": number[lang], "gram": key.astype(np.int64), "n": n})

    counted = rows.mapInPandas(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toPandas().sort_values(["lang", "gram"])
    trees = []
    for i in range(len(languages)):
        own = table[table["lang"] == i]
        trees.append(Tree(own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy().astype(float)))
    return Model(languages, trees)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its posterior among the languages, all equally likely
    before) and ``bits_per_byte`` of the best language."""
    docs = without(docs, "lang_pred", "score", "bits_per_byte")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = shipped.value
        for texts in batches:
            lang = np.full(len(texts), UNKNOWN, dtype=object)
            score, rate = np.zeros(len(texts)), np.full(len(texts), np.nan)
            known = [i for i, t in enumerate(texts) if t and trees.languages and LETTER.search(t)]
            if known:
                data = [texts.iat[i].lower().encode() for i in known]
                bits = trees.score(data)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                lang[known] = np.array(trees.languages, dtype=object)[best]
                score[known] = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
                rate[known] = least / np.array([len(d) for d in data])
            yield pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": rate})

    return docs.withColumn("_id", identify(F.col(text))).select(*[f"`{c}`" for c in docs.columns], "_id.*")


def held_out(folds: int, fold: int) -> Column:
    """Whether a document's id falls into the fold that is never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
