"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a byte string, table entry ``i`` holds the one token that ends the encoding of the first ``i``
bytes. It is unique: a token ``t`` ending there is right exactly if the token that ends the prefix
before it and ``t`` are neighbours that the merges would leave apart. So the table is filled left to
right, an append only adds entries, and after an edit the entries settle again near it. Whether two
tokens may be neighbours is found by undoing merges at their border, newest first, and remembered.

Texts are split by the pattern first; each piece is encoded alone. A piece that is a token itself
is that token. Results of pieces are remembered in each Python worker, up to a stated number.

Edge cases: a null or empty text has no tokens; very long pieces take time in proportion to their
length; special tokens are ordinary text; bytes that are not UTF-8 decode to themselves. Repeated
rows are encoded alike and other columns are carried. Added columns replace those of their names.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.llm.frames import without
from driftline.llm.inttable import IntTable

#: Remembered pieces per worker; beyond it the memory is emptied and filled anew.
REMEMBERED = 400_000
#: Pieces of more bytes are filled alone; others this many together.
LONG = 64
TOGETHER = 32_768
#: Rows encoded at once.
ROWS = 512


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes and ranks from lines of base64 text and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranked tokens with what encoding needs: the last merge of each token and the neighbour rule."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: Tokens that merges can build, the longest first at each end of a prefix.
        self.built: dict[bytes, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        # In rank order: the parts of a token are neighbours that stay apart without the token itself.
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._parts(token)
            if parts:
                self.halves[rank], self.merged[parts] = parts, rank
            if parts or len(token) == 1:
                self.built[token] = rank
        self.longest = max(map(len, self.built), default=1)
        self.known: dict[tuple[int, int], bool] = {}

    def _parts(self, token: bytes) -> tuple[int, int] | None:
        for cut in range(1, len(token)):
            left, right = self.built.get(token[:cut]), self.built.get(token[cut:])
            if left is not None and right is not None and self.stay_apart(left, right):
                return left, right
        return None

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merges leave ``left`` and ``right`` as neighbours.

        The tokens at the border are unmerged, newest first. A pair that stood at the border would have
        merged if its own merge comes before the merges that covered the left or the right one. Of two
        merges of one rank the left one comes first.
        """
        later_left = later_right = float("inf")
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < later_left and joint <= later_right:
                return False
            undo_left, undo_right = self.halves.get(left), self.halves.get(right)
            if undo_left and (left > right or not undo_right):
                later_left, left = left, undo_left[1]
            elif undo_right:
                later_right, right = right, undo_right[0]
            else:
                return True

    def neighbours(self, left: int, right: int) -> bool:
        pair = left, right
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= 2 * REMEMBERED:
                self.known.clear()
            found = self.known[pair] = self.stay_apart(left, right)
        return found


class PrefixTable:
    """The unique last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, begin: int, until: int) -> None:
        """Entries ``begin`` to ``until``; those before must be there."""
        vocabulary, data, last = self.vocabulary, self.data, self.last
        token_of, known, longest = vocabulary.built.get, vocabulary.known, vocabulary.longest
        for end in range(begin, until + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(data[start:end])
                if token is not None:
                    if start == 0:
                        break
                    apart = known.get((last[start], token))
                    if apart is None:
                        apart = vocabulary.neighbours(last[start], token)
                    if apart:
                        break
            else:
                raise ValueError("a byte has no token")
            last.append(token)

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        self._fill(begin + 1, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; returns how many entries were computed.

        Behind the edit, entries are computed until as many as the longest token has bytes agree with
        the old ones; all that follow depend on these alone and are kept.
        """
        tail = self.last[stop + 1:]
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start + 1:]
        first_old = start + len(new)
        agree = 0
        for end in range(start + 1, len(self.data) + 1):
            self._fill(end, end)
            if end > first_old:
                agree = agree + 1 if tail[end - first_old - 1] == self.last[end] else 0
                if agree >= self.vocabulary.longest:
                    self.last += tail[end - first_old:]
                    return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Filler:
    """Fills the prefix tables of many pieces at once.

    A trie of the tokens is walked from every start position of all pieces together; where a token
    ends, the neighbour rule decides, looked up by the pair and worked out once per pair.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        nodes: dict[bytes, int] = {b"": 0}
        for token in vocabulary.built:
            for end in range(1, len(token) + 1):
                nodes.setdefault(token[:end], len(nodes))
        self.token_at = np.full(len(nodes), -1, dtype=np.int32)
        for token, rank in vocabulary.built.items():
            self.token_at[nodes[token]] = rank
        steps = [(nodes[text[:-1]] << 8 | text[-1], node) for text, node in nodes.items() if text]
        keys, values = zip(*steps) if steps else ((), ())
        self.steps = IntTable(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32))
        self.apart = IntTable()
        self.size_of = np.zeros(max(vocabulary.bytes_of, default=0) + 1, dtype=np.int64)
        for rank, token in vocabulary.bytes_of.items():
            self.size_of[rank] = len(token)

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        known = self.apart.get(pairs)
        new = np.unique(pairs[known < 0])
        if len(new):
            if self.apart.count >= 2 * REMEMBERED:
                self.apart = IntTable()
            rule = self.vocabulary.stay_apart
            found = [rule(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()]
            if self.apart.count:
                fresh = new[self.apart.get(new) < 0]
                found = [f for f, n in zip(found, np.isin(new, fresh)) if n]
                new = fresh
            self.apart.add(new, np.array(found, dtype=np.int32))
            known = self.apart.get(pairs)
        return known == 1

    def fill(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces behind each other, and how many each piece has."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max(initial=0))
        data = np.zeros((len(pieces), width + 1), dtype=np.uint64)
        data[np.arange(width + 1) < sizes[:, None]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        last = np.full((len(pieces), width + 1), -1, dtype=np.int32)
        for start in range(width):
            rows = np.flatnonzero(sizes > start)
            node = np.zeros(len(rows), dtype=np.uint64)
            for end in range(start + 1, width + 1):
                step = self.steps.get(node << np.uint64(8) | data[rows, end - 1])
                alive = (step >= 0) & (sizes[rows] >= end)
                rows, node = rows[alive], step[alive].astype(np.uint64)
                if not len(rows):
                    break
                token = self.token_at[node]
                ends = np.flatnonzero((token >= 0) & (last[rows, end] < 0))
                if start and len(ends):
                    ends = ends[self._stay_apart(last[rows[ends], start], token[ends])]
                last[rows[ends], end] = token[ends]
        return self._tokens(last, sizes)

    def _tokens(self, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks back from the ends of all pieces together."""
        found, rows, ends = [], np.arange(len(sizes)), sizes
        while len(rows):
            token = last[rows, ends]
            found.append((rows, token))
            ends = ends - self.size_of[token]
            rows, ends = rows[ends > 0], ends[ends > 0]
        owner = np.concatenate([r for r, _ in found[::-1]])
        tokens = np.concatenate([t for _, t in found[::-1]])
        return tokens[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))


class Encoder:
    """Encodes texts by pattern and vocabulary; remembers pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.filler = Filler(vocabulary)
        self._forget()

    def _forget(self) -> None:
        #: Number of each remembered piece; its tokens are ``flat[first[n]:first[n] + size[n]]``.
        self.pieces: dict[str, int] = {}
        self.flat, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not remembered."""
        data = [p.encode() for p in pieces]
        whole = list(map(self.vocabulary.ranks.get, data))
        names, tokens, sizes = [], [], []
        rest = []
        for piece, own, rank in zip(pieces, data, whole):
            if rank is not None:
                names.append(piece)
                tokens.append([rank])
            elif len(own) > LONG:
                names.append(piece)
                tokens.append(PrefixTable(self.vocabulary, own).tokens())
            else:
                rest.append((piece, own))
        sizes.append(np.array([len(t) for t in tokens], dtype=np.int64))
        flat = [np.fromiter(chain.from_iterable(tokens), np.int32)]
        rest.sort(key=lambda x: len(x[1]))
        for start in range(0, len(rest), TOGETHER):
            part = rest[start:start + TOGETHER]
            found, n = self.filler.fill([own for _, own in part])
            names += [piece for piece, _ in part]
            flat.append(found)
            sizes.append(n)
        self.pieces.update(zip(names, range(len(self.pieces), len(self.pieces) + len(names))))
        self.flat = np.concatenate([self.flat, *flat]).astype(np.int32)
        self.size = np.concatenate([self.size, *sizes])
        self.first = np.cumsum(self.size) - self.size

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts behind each other, and how many each text has."""
        split = [self.split(t or "") for t in texts]
        if len(self.pieces) >= REMEMBERED:
            self._forget()
        self._learn(list(set().union(*split).difference(self.pieces)))
        number = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int64)
        size = self.size[number]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[number] - (ends - size), size)
        pieces_until = np.cumsum([0] + [len(s) for s in split])
        tokens_until = np.concatenate([[0], ends])[pieces_until]
        return self.flat[at], np.diff(tokens_until)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, tokens: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, tokens))


#: The encoder of this worker, kept between tasks with what it remembers.
_KEPT: dict[str, Encoder] = {}


def _kept(name: str, shipped, pattern: str) -> Encoder:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Encoder(shipped.value, pattern)
    return _KEPT[name]


def load_vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a local rank file. It is shipped to the workers, so only the driver needs the file."""
    with open(path, "rb") as lines:
        return Vocabulary(read_ranks(lines))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: what a worker holds does not depend on the size of the batches sent to it."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def encode_documents(
    docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", decode: bool = False
) -> DataFrame:
    """``docs`` with ``tokens`` (array of int) and ``n_tokens``; with ``decode`` also ``decoded``, the
    bytes that the tokens decode to, in the same pass."""
    added = {"tokens": "array<int>", "n_tokens": "long"} | ({"decoded": "binary"} if decode else {})
    docs = without(docs, *added)
    shipped, name = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    place = docs.columns.index(text)
    more = StructType.fromDDL(", ".join(f"{column} {kind}" for column, kind in added.items()))
    schema = StructType([*docs.schema.fields, *more.fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept(name, shipped, pattern)
        for batch in _slices(batches):
            ids, sizes = encoder.encode_all(batch.column(place).to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            offsets = pa.array(ends, pa.int32())
            columns = [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(sizes)]
            if decode:
                columns.append(pa.array([encoder.decode(ids[s:e].tolist()) for s, e in zip(ends, ends[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``tokens`` (null: null)."""
    encoded = without(encoded, "decoded")
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary.bytes_of)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = shipped.value.__getitem__
        for lists in batches:
            yield pd.Series([None if x is None else b"".join(map(bytes_of, x.tolist())) for x in lists], dtype=object)

    return encoded.withColumn("decoded", decode(F.col("tokens")))
