"""Problem 3: oversized items cut into pieces under a limit, at natural boundaries where possible.

Balanced targets: the least number of pieces gives equal-length targets; each
target snaps to the strongest boundary inside half a target's length; where a
piece then breaks the limit, pieces are added there: it is laid out anew like an
item of its own, between cuts that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbase.operators.intervals import BIN_WIDTH, merge_intervals

PIECE = pa.struct([("first", pa.int64()), ("second", pa.int64()), ("cut_first", pa.int64()), ("stretches", pa.list_(pa.int64()))])
PIECE_SQL = "array<struct<first:bigint,second:bigint,cut_first:bigint,stretches:array<bigint>>>"


def letter_stretches(refseq: DataFrame, least: int = 10, letter: str = "N") -> DataFrame:
    """``contig``, ``first``, ``last`` (0-based) of each stretch of ``least`` or more of ``letter``, either case, across tiles.

    Tiles are scanned where they lie; only runs are merged. Rows may come in any
    order, twice, or overlap; null sequences and empty tiles hold no stretch.
    """
    code = (ord(letter.upper()), ord(letter.lower()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contig, first, last = [], [], []
            for c, start, seq in zip(*(x.to_pylist() for x in b.columns), strict=True):
                raw = np.frombuffer((seq or "").encode(), np.uint8)
                hit = np.concatenate([[False], (raw == code[0]) | (raw == code[1]), [False]])
                edge = np.flatnonzero(hit[1:] != hit[:-1])
                a, z = edge[::2], edge[1::2]
                keep = (z - a >= least) | (a == 0) | (z == len(raw))  # one at a tile's edge may go on
                first += (a[keep] + start).tolist()
                last += (z[keep] - 1 + start).tolist()
                contig += [c] * int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array(contig, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["contig", "first", "last"])

    tiles = refseq.where("contig is not null and tile_start is not null").select("contig", "tile_start", "seq")
    runs = tiles.mapInArrow(scan, "contig string, first bigint, last bigint")
    merged = merge_intervals(runs, ["contig"], "first", "last", bin_width=BIN_WIDTH).where("kind = 'merged'").drop("kind")
    return merged.where(F.col("last") - F.col("first") + 1 >= least)


def _snap(first: int, length: int, n: int, overlap: int, middle: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of pieces 2..n, the boundary each snapped to or -1): equal targets, each snapped to the strongest boundary within half a target, the nearest of equals."""
    target = (length - overlap) / n
    ideal = first + np.arange(1, n) * target
    starts, chosen = first + np.arange(1, n) * (length - overlap) // n, np.full(n - 1, -1)
    slot = np.floor((middle - first) / target + 0.5).astype(np.int64)  # the windows of half a target don't overlap
    at = np.flatnonzero((slot >= 1) & (slot < n))
    if len(at):
        order = at[np.lexsort((middle[at], np.abs(middle[at] - ideal[slot[at] - 1]), -strength[at], slot[at]))]
        best = order[np.append(True, slot[order][1:] != slot[order][:-1])]
        starts[slot[best] - 1], chosen[slot[best] - 1] = middle[best], best
    return starts, chosen


def balanced_pieces(first: int, second: int, limit: int, overlap: int, a: np.ndarray, z: np.ndarray) -> list[tuple[int, int, int]]:
    """Pieces (first, second, boundary's first or -1) of one item; a, z: its boundaries, sorted.

    Where snapping made a piece too long, this piece alone is laid out anew with
    the pieces that it needs; every other cut stays. Each layout cuts inside a
    piece that is too long, so that the work is linear in pieces and boundaries
    times the few layouts that lie in one another.
    """
    if second - first + 1 <= limit:
        return [(first, second, -1)]
    middle = (a + z + 1) // 2 - overlap // 2
    keep = (middle > first) & (middle + overlap <= second)
    order = np.argsort(middle[keep], kind="stable")
    middle, strength, origin = middle[keep][order], (z - a + 1)[keep][order], a[keep][order]
    done: list[tuple[int, int, int]] = []
    todo = [(first, second, -1)]
    while todo:
        s, e, cut = todo.pop()
        length = e - s + 1
        if length <= limit:
            done.append((s, e, cut))
            continue
        n = -(-(length - overlap) // (limit - overlap))
        lo, hi = np.searchsorted(middle, s, "right"), np.searchsorted(middle, e - overlap, "right")
        starts, chosen = _snap(s, length, n, overlap, middle[lo:hi], strength[lo:hi])
        begins = [s, *starts.tolist()]
        ends = [x + overlap - 1 for x in begins[1:]] + [e]
        cuts = [cut, *(int(origin[lo + i]) if i >= 0 else -1 for i in chosen.tolist())]
        todo += reversed(list(zip(begins, ends, cuts)))
    return done


def _owned(pieces: list[tuple[int, int, int]], a: np.ndarray) -> list[dict]:
    """The pieces with the boundaries that begin in each, before the next piece does."""
    starts = np.array([p[0] for p in pieces])
    at = np.searchsorted(starts, a, "right") - 1
    edge = np.searchsorted(at, np.arange(len(pieces) + 1))
    return [{"first": f, "second": s, "cut_first": c, "stretches": a[edge[i] : edge[i + 1]].tolist()} for i, (f, s, c) in enumerate(pieces)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first, second, limit, overlap = (b.column(i).to_pylist() for i in range(1, 5))
        out = []
        for i, bounds in enumerate(b.column(5).to_pylist()):
            pairs = np.array([(x["first"], x["last"]) for x in bounds], np.int64).reshape(-1, 2)
            shared = min(max(overlap[i] or 0, 0), limit[i] - 1)
            out.append(_owned(balanced_pieces(first[i], second[i], limit[i], shared, pairs[:, 0], pairs[:, 1]), pairs[:, 0]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array(out, pa.list_(PIECE))], names=["item", "boundaries", "pieces"])


def split_items(
    items: DataFrame,
    boundaries: DataFrame,
    id_col: str,
    key: str,
    first: str,
    second: str,
    limit: str | Column,
    overlap: str | Column,
    bin_width: int = 1 << 13,
) -> DataFrame:
    """One row per item longer than its limit: ``id_col``, ``boundaries`` (first, last) that lie wholly in it, ``pieces``.

    A piece has ``first``, ``second``, ``cut_first`` (the first position of the
    boundary at which it begins, or -1) and ``stretches``, the first positions of
    the boundaries that begin in it; each boundary belongs to one piece. An
    item's row holds its boundaries, one for each ten positions at most.

    Pieces cover the item in order, have at most ``limit`` positions, and
    consecutive ones share ``overlap`` positions, the boundary in the middle of
    what they share. Items meet boundaries of their ``key`` by bins of
    positions, so a key with many items or boundaries spreads over its bins.

    Defined cases: items with a null key, bound or limit, a limit below 1 or
    first > second are left out; a null overlap is 0, one as large as the limit
    is limit - 1; equal items count once; an item without a boundary is cut at
    the equal targets; empty tables give no rows; further columns are left out.
    """
    col = lambda x: F.col(x) if isinstance(x, str) else x
    long = items.select(
        F.col(id_col).alias("_id"), F.col(key).alias("_key"), F.col(first).cast("long").alias("_a"), F.col(second).cast("long").alias("_z"),
        col(limit).cast("long").alias("_limit"), F.coalesce(col(overlap).cast("long"), F.lit(0)).alias("_overlap"),
    ).where("_key is not null and _limit >= 1 and _z - _a + 1 > _limit").distinct()
    item = F.struct("_id", "_key")
    binned = long.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / bin_width), F.floor(F.col("_z") / bin_width))))
    at = boundaries.select(F.col(key).alias("_bkey"), F.col("first").alias("_bf"), F.col("last").alias("_bl"), F.floor(F.col("first") / bin_width).alias("_bbin"))
    inside = (F.col("_key") == F.col("_bkey")) & (F.col("_bin") == F.col("_bbin")) & (F.col("_bf") >= F.col("_a")) & (F.col("_bl") <= F.col("_z"))
    bound = F.when(F.col("_bf").isNotNull(), F.struct(F.col("_bf").alias("first"), F.col("_bl").alias("last")))
    met = binned.join(at, inside, "left").groupBy(item.alias("item"), "_a", "_z", "_limit", "_overlap").agg(F.sort_array(F.collect_list(bound)).alias("boundaries"))
    types = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    cut = met.select("item", "_a", "_z", "_limit", "_overlap", "boundaries").mapInArrow(_cut, f"item {types['item']}, boundaries {types['boundaries']}, pieces {PIECE_SQL}")
    return cut.select(F.col("item._id").alias(id_col), F.col("item._key").alias(key), "boundaries", "pieces")
