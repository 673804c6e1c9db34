"""Problem 6: encoding of the whole corpus with a public byte-level BPE vocabulary.

Documents stay where they lie: one narrow pass, no shuffle. In a task, texts are
split into pieces by the vocabulary's pattern; pieces not seen before are put
into padded numpy matrices by length, and all rows of a matrix are merged at
once: each round every row merges its leftmost pair of minimum rank, ranks come
from a hash table of pairs, and rows are compacted as they shrink and finish.
Pieces too long for a matrix are merged as one ragged array, in which a round
merges every occurrence of each row's minimum pair, which gives the same ids:
a pair that a merge makes new never ranks below the merge itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the public vocabularies lie by default; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longest piece, in bytes, that goes into a matrix.
LONGEST_ROW = 128
#: Pieces that a worker keeps with their ids; at this number it begins anew.
KEPT_PIECES = 400_000
NO_PAIR = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of the merged token, which is also its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(merged)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NO_PAIR."""
        keys = left.astype(np.int64).ravel() << 32 | (right.astype(np.int64).ravel() & 0xFFFFFFFF)
        slot, out = self._slot(keys), np.full(len(keys), NO_PAIR, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Encoder:
    """Byte-level BPE of a rank file; the pieces met so far are kept, within a bound."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError(f"{path} has no token for some byte")
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_PIECES:
            self.kept = {}
        kept = self.kept
        new = list({p for ps in pieces for p in ps} - kept.keys())
        if new:
            kept.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        return [[i for p in ps for i in kept[p]] for ps in pieces]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            if 1 << b > LONGEST_ROW:
                ids, ends = self._merge_ragged([pieces[i] for i in rows])
                for i, part in zip(rows, np.split(ids, ends[:-1]), strict=True):
                    out[i] = part.tolist()
                continue
            width = int(sizes[rows].max())
            raw = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)
            m = np.full((len(rows), width), -1, np.int32)
            m[np.arange(width) < sizes[rows, None]] = self.of_byte[raw]
            for i, row in zip(rows, self._merge_matrix(m, sizes[rows].copy()), strict=True):
                out[i] = row
        return out

    def _merge_matrix(self, m: np.ndarray, size: np.ndarray) -> list[list[int]]:
        done: list[list[int]] = [[]] * len(m)
        index = np.arange(len(m))
        rank = self.pairs.look_up(m[:, :-1], m[:, 1:])
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(m), np.int64)
            low = rank[np.arange(len(m)), at] if rank.shape[1] else np.full(len(m), NO_PAIR)
            ended = low == NO_PAIR
            if ended.any():
                for i, row, n in zip(index[ended], m[ended].tolist(), size[ended], strict=True):
                    done[i] = row[:n]
                going = ~ended
                index, m, size, rank, at, low = index[going], m[going], size[going], rank[going], at[going], low[going]
                if not len(m):
                    return done
                wide = int(size.max())
                m, rank = m[:, :wide], rank[:, : wide - 1]
            r, wide = np.arange(len(m)), m.shape[1]
            cols = np.arange(wide - 1)
            m[r, at] = low
            kept = np.take_along_axis(m, cols + (cols > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= at[:, None]), axis=1)
            m, size = kept, size - 1
            if wide > 2:
                one = np.flatnonzero(at > 0)
                rank[one, at[one] - 1] = self.pairs.look_up(m[one, at[one] - 1], m[one, at[one]])
                two = np.flatnonzero(at < wide - 2)
                rank[two, at[two]] = self.pairs.look_up(m[two, at[two]], m[two, at[two] + 1])

    def _merge_ragged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        while True:
            rank = np.full(len(ids), NO_PAIR, np.int32)
            inner = np.flatnonzero(row[1:] == row[:-1])
            rank[inner] = self.pairs.look_up(ids[inner], ids[inner + 1])
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            low = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(low, np.diff(np.append(starts, len(row))))) & (rank != NO_PAIR)
            if not hit.any():
                return ids, np.append(starts[1:], len(ids))
            # of pairs that overlap (a a a) the first, third, ... merge
            i = np.arange(len(ids))
            begin = hit & ~np.append(False, hit[:-1])
            hit &= (i - np.maximum.accumulate(np.where(begin, i, 0))) % 2 == 0
            ids = np.where(hit, rank, ids)
            keep = ~np.append(False, hit[:-1])
            ids, row = ids[keep], row[keep]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """``id_col`` and ``ids`` (or ``n_tokens``) of every row's text.

    Strings that look like special tokens are ordinary text. ``vocabulary`` is
    the path of a rank file that every executor can read.

    Defined cases: null and empty texts give an empty list; null ids and
    repeated rows are encoded like any; texts and pieces may have any length;
    an empty table gives no rows; further columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    name, sql = ("n_tokens", "bigint") if counts_only else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            ids = enc.encode(b.column(1).to_pylist())
            col = pa.array([len(x) for x in ids], pa.int64()) if counts_only else _lists(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), col], names=["_id", name])

    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {name} {sql}")
    return out.withColumnRenamed("_id", id_col)
