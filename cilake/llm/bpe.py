"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

A text is cut into pieces by the tokenizer's pattern; each distinct piece of a slab of texts is encoded once.
Pieces of like length form a padded matrix, one piece a row. Each round every row merges its leftmost pair of
minimum rank; ranks of pairs come from a hash table in numpy arrays (open addressing), and only the two pairs
around a merge are looked up again. Finished rows leave the matrix (compaction). A piece longer than
`LONG_BYTES` is encoded alone, with a heap of pairs, by the same rule; its matrix would take quadratic work.

Decoding joins the tokens' bytes by offset arrays; it gives back the text's UTF-8 bytes exactly.

The vocabulary (under 1 MB, a fixed file) is read on the driver and broadcast. Rows are handled where they lie:
no shuffle; memory holds one Arrow batch and one slab of pieces.

Defined cases: a null or empty text has no tokens (an empty array) and decodes to no bytes; null token lists decode
like empty ones; an id outside the vocabulary fails the decoding. Special tokens are plain text. Existing columns
named like a result column are replaced by it.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cilake.llm.common import fresh, slabs, small_batches

LONG_BYTES = 1024
CACHED_PIECES = 150_000
_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[k] for k in range(len(ranks))]


class PairTable:
    """(left id, right id) -> id of the merged token, for arrays of pairs; `_NONE` where there is no merge."""

    def __init__(self, tokens: list[bytes]):
        number = {t: k for k, t in enumerate(tokens)}
        found = [(number[t[:c]], number[t[c:]], k) for k, t in enumerate(tokens)
                 for c in range(1, len(t)) if t[:c] in number and t[c:] in number]
        pairs = np.array(found, np.int64).reshape(-1, 3)
        keys = self._key(pairs[:, 0], pairs[:, 1])
        self.bits = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.bits))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ids = np.full(self.mask + 1, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # claim free slots; the losers of a slot step on
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]
            won = self.keys[slot[left]] == keys[left]
            self.ids[slot[left[won]]] = pairs[left[won], 2]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask
        self.first = np.array([number[bytes([b])] for b in range(256)], np.int32)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 24) | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.bits).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ids[slot], _NONE)
        open_ = np.nonzero((seen != keys) & (seen >= 0))
        while len(open_[0]):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            match = seen == keys[open_]
            hit = tuple(x[match] for x in open_)
            out[hit] = self.ids[slot[hit]]
            go = ~match & (seen >= 0)
            open_ = tuple(x[go] for x in open_)
        return out


def gather(flat: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[start[k] : start[k] + counts[k]], one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(start - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


def merge_rows(table: PairTable, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, count of each); pieces of like length, a row of one padded matrix each."""
    lengths = np.array([len(p) for p in pieces])
    width = int(lengths.max())
    column = np.arange(width)
    ids = np.zeros((len(pieces), width), np.int32)
    ids[column < lengths[:, None]] = table.first[np.frombuffer(b"".join(pieces), np.uint8)]
    ranks = table.get(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(pieces), 0), np.int32)
    ranks[column[1:] >= lengths[:, None]] = _NONE
    row = np.arange(len(pieces))
    ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, their counts, their ids
    while len(row):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
        best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), _NONE)
        done = best == _NONE
        if done.any():
            ended.append((row[done], lengths[done], ids[done][column < lengths[done][:, None]]))
        go = ~done
        row, at, best, lengths = row[go], at[go], best[go], lengths[go] - 1
        if not len(row):
            break
        here = np.arange(len(row))
        width = int(lengths.max())
        column = np.arange(width)
        later = column > at[:, None]
        ids = np.where(later, ids[go][:, 1 : width + 1], ids[go][:, :width])
        ids[here, at] = best
        old = ranks[go]
        ranks = np.where(later[:, : width - 1], old[:, 1:width], old[:, : width - 1])
        for side in (at - 1, at):  # the pairs that now end or start with the merged token
            ok = (side >= 0) & (side + 1 < lengths)
            ranks[here[ok], side[ok]] = table.get(ids[here[ok], side[ok]], ids[here[ok], side[ok] + 1])
        ranks[column[1:] >= lengths[:, None]] = _NONE
    rows, counts, flat = (np.concatenate(x) for x in zip(*ended, strict=True))
    order = np.argsort(rows)
    return gather(flat, (np.cumsum(counts) - counts)[order], counts[order]), counts[order]


def merge_long(table: PairTable, piece: bytes) -> np.ndarray:
    """Token ids of one long piece: a heap of (rank, position) over a linked list of parts."""
    ids = table.first[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(table.get(np.array([a]), np.array([b]))[0])
        return known[a, b]

    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank(ids[k], ids[k + 1])) != _NONE]
    heapq.heapify(heap)
    while heap:
        merged, k, left, right = heapq.heappop(heap)
        j = after[k]
        if ids[k] != left or j >= n or ids[j] != right:
            continue  # one of the two parts has merged with another meanwhile
        ids[k], ids[j] = merged, -1
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if (r := rank(merged, ids[after[k]])) != _NONE:
                heapq.heappush(heap, (r, k, merged, ids[after[k]]))
        if before[k] >= 0 and (r := rank(ids[before[k]], merged)) != _NONE:
            heapq.heappush(heap, (r, before[k], ids[before[k]], merged))
    return np.array([x for x in ids if x >= 0], np.int32)


class Encoder:
    """Encodes texts; keeps the ids of pieces met so far, up to a bound (then it starts anew)."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PairTable | None = None):
        self.table = table or PairTable(tokens)
        self.split = regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new piece gets the next number
        self.flat = np.zeros(0, np.int32)
        self.start = self.count = np.zeros(0, np.int64)

    def _encode_new(self, known: int) -> None:
        """Append the ids of the pieces numbered from `known` on."""
        pieces = [p.encode() for p in list(self.number)[known:]]
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], [1, 2, 3, 5, 7, 9, 12, 16, 24, 32, 64, 128, 256, 512, LONG_BYTES + 1])
        flat, counts = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            widest = int(sizes[order[b - 1]]) if b > a else 1
            for k in range(a, b, step := max(1, 400_000 // widest)):
                ids, n = merge_rows(self.table, [pieces[x] for x in order[k : min(b, k + step)]])
                flat.append(ids)
                counts.append(n)
        for i in order[cuts[-1] :]:
            flat.append(merge_long(self.table, pieces[i]))
            counts.append(np.array([len(flat[-1])]))
        n = np.concatenate(counts)
        self.flat = np.concatenate([self.flat, *flat])
        starts, all_counts = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        starts[order], all_counts[order] = len(self.flat) - n.sum() + np.cumsum(n) - n, n
        self.start, self.count = np.concatenate([self.start, starts]), np.concatenate([self.count, all_counts])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text in them)."""
        if len(self.number) > CACHED_PIECES:
            self._reset()
        known, number = len(self.number), self.number.__getitem__
        met = [list(map(number, self.split(t))) for t in texts]
        if len(self.number) > known:
            self._encode_new(known)
        pieces = np.fromiter(chain.from_iterable(met), np.int64)
        counts = self.count[pieces]
        ends = np.concatenate([[0], np.cumsum(counts)])
        last = np.cumsum([0, *map(len, met)])
        return gather(self.flat, self.start[pieces], counts), ends[last]


@lru_cache(maxsize=1)
def _table(tokens: tuple[bytes, ...]) -> PairTable:
    """Kept by the worker; the pieces met so far are kept by the task alone."""
    return PairTable(list(tokens))


def vocabulary(spark: SparkSession, path: str):
    """The tokens of a ranks file as a broadcast variable."""
    return spark.sparkContext.broadcast(tuple(read_ranks(path)))


def encoded(text: Column, tokens, pattern: str) -> Column:
    """Column function text -> array<int>; `tokens` as given by `vocabulary`."""

    held: list[Encoder] = []

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder([], pattern, _table(tokens.value)))
        run = held[0]
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        parts, bounds, base = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for a, b in slabs(sizes):
            ids, ends = run([x.as_py() or "" for x in texts[a:b]])
            parts.append(ids)
            bounds.append(ends[1:] + base)
            base += len(ids)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(bounds), pa.int32()), pa.array(np.concatenate(parts)))

    return encode(text)


def decode_ids(ids: np.ndarray, data: np.ndarray, start: np.ndarray) -> bytes:
    """The bytes of a token list; `data[start[k]:start[k + 1]]` are those of token k."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < len(start) - 1:
        raise ValueError("token id outside the vocabulary")
    return gather(data, start[ids], start[ids + 1] - start[ids]).tobytes()


def decoded(ids: Column, tokens) -> Column:
    """Column function array<int> -> binary."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        data = np.frombuffer(b"".join(tokens.value), np.uint8)
        start = np.concatenate([[0], np.cumsum([len(t) for t in tokens.value])]).astype(np.int64)
        none = np.zeros(0, np.int64)
        return pa.array([decode_ids(none if x.values is None else x.values.to_numpy(zero_copy_only=False), data, start)
                         for x in lists], pa.binary())

    return decode(ids)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of `text`."""
    return small_batches(docs).withColumn(ids, encoded(F.col(text), vocabulary(docs.sparkSession, path), pattern))


def decode(docs: DataFrame, path: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """`docs` with the bytes that `ids` stand for."""
    return docs.withColumn(data, decoded(F.col(ids), vocabulary(docs.sparkSession, path)))


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with ids, n_tokens, ids_sha256 and decoded_sha256, for comparing runs without the tokens themselves."""
    tokens = vocabulary(docs.sparkSession, path)
    (data,) = fresh(docs, "_data")
    coded = small_batches(docs).withColumn(ids, encoded(F.col(text), tokens, pattern)).withColumn(data, decoded(F.col(ids), tokens))
    return coded.withColumn("n_tokens", F.size(ids).cast("bigint")).withColumn(
        "ids_sha256", F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)).withColumn(
        "decoded_sha256", F.sha2(F.col(data), 256)).drop(data)
