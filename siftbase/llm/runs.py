"""Problem 1: runs of near-identical consecutive events become one event each.

The segmentation is the optimum of a dynamic program. A run costs a boundary
penalty and its within-run dissimilarity: ``weight`` times the sum of squared
deviations of its values from their means, and infinity where a value leaves the
tolerance:

    best(i) = min over candidates j in (i, reach(i)] of  penalty + weight * deviations(i..j-1) + best(j)

``reach(i)`` is the first event that can't be in a run that begins at ``i``. Two
prunings drop a candidate for good. The tolerance is hereditary (each part of a
run inside it is inside it), so that a candidate beyond ``reach(i)`` is beyond
it for every earlier start. And deviations are never less than those of two
parts, so that a candidate whose ``weight * deviations + best(j)`` is above
``best(i)`` can't be better than a boundary at ``i`` for any earlier start. Of
several optima the one whose earlier runs are longest is taken.

At weight 0 a run inside the tolerance is free but for its boundary. Then
``best`` never rises along the events, the last candidate of an event is its best,
and the optimum is the chain first, reach(first), ..., which is found in bins of
positions with the open run handed on (``segments.py``). With a weight, events
are parted where a run must end whatever lies around: at a position that is
missing, and between two neighbours that alone leave the tolerance. The parts
are independent programs, so an entity spreads over its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbase.operators.carry import neighbours, packed, running
from siftbase.operators.segments import Tolerance, chain, changed, reaches, tolerant_segments, whole_groups

#: Costs count as equal within this share of them.
EQUAL = 1e-9


def optimum(v: np.ndarray, forced: np.ndarray, tol: Tolerance, penalty: float = 1.0, weight: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(events that begin a run, as a mask; best cost from each event to the end of its part). ``forced`` marks events that begin a part."""
    n = len(v)
    reach = reaches(v, forced, tol)
    start = np.flatnonzero(np.append(True, forced[1:])) if n else np.zeros(0, np.int64)
    end = np.append(start[1:], n)
    part = np.repeat(np.arange(len(start)), end - start)
    if not weight:  # of all candidates the last is the best, at every event
        jump, best = np.append(np.where(reach == end[part], n, reach), n) if n else np.zeros(1, np.int64), np.append(np.full(n, float(penalty)), 0.0)
        while (jump < n).any():
            best, jump = best + best[jump], jump[jump]
        return (chain(reach) if n else np.zeros(0, bool)), best[:n]
    v = v.astype(np.float64) - v[start[part]]  # near 0, so that sums of squares keep their digits
    one = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)])
    two = np.append(0.0, np.cumsum((v * v).sum(axis=1)))
    best, choice = np.zeros(n + len(start)), np.zeros(n, np.int64)  # each part has a place for its end, where the cost is 0
    order = np.argsort(start - end, kind="stable")  # longest part first: those still going are the first ones
    lengths = (end - start)[order]
    cand = end[order][:, None]
    for t in range(1, int(lengths.max(initial=0)) + 1):  # all parts at once, from their ends
        k = int(np.searchsorted(-lengths, -t, side="right"))
        p, cand = order[:k], cand[:k]
        i = end[p] - t
        there = (cand > i[:, None]) & (cand <= reach[i][:, None])
        j = np.where(there, cand, i[:, None] + 1)
        sums = one[j] - one[i][:, None]
        dev = np.maximum(two[j] - two[i][:, None] - (sums * sums).sum(axis=2) / (j - i[:, None]), 0.0)
        inner = np.where(there, weight * dev + best[j + p[:, None]], np.inf)
        low = inner.min(axis=1)
        near = inner <= (low + EQUAL * (1 + np.abs(low)))[:, None]
        choice[i] = np.where(near, j, 0).max(axis=1)
        best[i + p] = penalty + low
        keep = there & (inner <= (penalty + low + EQUAL * (1 + np.abs(low)))[:, None])
        width = int(keep.sum(axis=1).max(initial=0))
        first = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        kept = np.where(np.take_along_axis(keep, first, 1), np.take_along_axis(cand, first, 1), -1)
        cand = np.concatenate([i[:, None], kept], axis=1)
    return (chain(choice) if n else np.zeros(0, bool)), best[np.arange(n) + part]


def _solver(keys: int, tol: Tolerance, zero: int | None, penalty: float, weight: float):
    """Runs of whole parts sorted by keys, part, position and id. Columns: keys, part, position, id, values."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(keys + 1)(batches):
            cols = [c.chunk(0) if c.num_chunks else c.combine_chunks() for c in t.columns]
            pos = cols[keys + 1].to_numpy().astype(np.int64)
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in cols[keys + 3 :]], axis=1)
            forced = np.ones(len(pos), bool)
            forced[1:] = np.logical_or.reduce([changed(c) for c in cols[: keys + 1]]) | (pos[1:] != pos[:-1] + 1)
            if zero is not None:
                forced[1:] |= (v[1:, zero] == 0) != (v[:-1, zero] == 0)
            marks, _ = optimum(v, forced, tol, penalty, weight)
            begin = np.flatnonzero(marks)
            stop = np.append(begin[1:], len(pos))
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(begin)) for c in cols[:keys]], pa.array(pos[begin]), pa.array(pos[stop - 1]), pa.array(stop - begin)], names=[*t.column_names[:keys], "seg_first", "seg_last", "n_records"]
            )

    return solve


def _weighted(events: DataFrame, keys: list[str], values: list[str], tol: Tolerance, zero: int | None, penalty: float, weight: float, bin_width: int) -> DataFrame:
    rows = neighbours(events.dropDuplicates(["_key", "_pos", "_id"]), ["_key"], "_pos", ["_id", *values], bin_width, tie="_id")
    ends = F.coalesce(F.col("_prev._pos") != F.col("_pos") - 1, F.lit(True))
    for i, c in enumerate(values):
        lo, hi = F.least(F.col(c), F.col(f"_prev.{c}")), F.greatest(F.col(c), F.col(f"_prev.{c}"))
        ends = ends | (tol.den * (hi - lo) > F.greatest(F.lit(tol.den * tol.absolute), tol.num * lo))
        if i == zero:
            ends = ends | ((F.col(c) == 0) != (F.col(f"_prev.{c}") == 0))
    rows = running(rows, ["_key"], [F.col("_pos"), F.col("_id")], ends.cast("int"), "_part", "sum")
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.select(*[F.col("_key")[k].alias(a) for k, a in zip(keys, names, strict=True)], "_part", "_pos", "_id", *values)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    by_part = rows.repartition(*names, "_part").sortWithinPartitions(*names, "_part", "_pos", "_id")
    sql = ", ".join([*(f"{a} {types[a]}" for a in names), "seg_first bigint, seg_last bigint, n_records bigint"])
    runs = by_part.mapInArrow(_solver(len(keys), tol, zero, penalty, weight), sql)
    return runs.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def collapse_runs(
    df: DataFrame,
    keys: list[str],
    pos: str,
    values: list[str],
    id_col: str,
    tolerance: Tolerance | None = None,
    zero_splits: str | None = None,
    bin_width: int = 1 << 13,
    penalty: float = 1.0,
    weight: float = 0.0,
) -> DataFrame:
    """One row per run of near-identical consecutive events: ``keys``, ``pos_first``, ``pos_last``, ``n_records``, ``n_bases``.

    The runs cost least: ``penalty`` for each and ``weight`` times the squared
    deviations inside it. Inside a run positions rise by one, every value stays
    inside ``tolerance``, and the value ``zero_splits``, if given, is 0 in all or
    in none. At weight 0 events are shuffled once, by (keys, bin), and then only
    summaries move; with a weight a part without a forced end is one program.

    Defined cases: events with a null position or value are left out; null keys
    are an entity of their own; events equal in keys, position and ``id_col``
    count once; other events at one position each begin a run, as the position
    isn't one more; a single event is a run of one; an empty table gives no
    rows; further columns are left out.
    """
    if penalty <= 0 or weight < 0:
        raise ValueError("penalty must be above 0, weight not below")
    tol = tolerance or Tolerance()
    names = [f"_v{i}" for i in range(len(values))]
    events = df.dropna(subset=[pos, *values])
    if not weight:
        runs = tolerant_segments(events, keys, pos, values, tol, id_col=id_col, zero_splits=zero_splits, bin_width=bin_width)
        runs = runs.withColumn("n_records", F.col("seg_last") - F.col("seg_first") + 1)
    else:
        events = events.select(packed(keys).alias("_key"), F.col(pos).cast("long").alias("_pos"), F.col(id_col).alias("_id"), *[F.col(c).alias(a) for c, a in zip(values, names, strict=True)])
        runs = _weighted(events, keys, names, tol, values.index(zero_splits) if zero_splits else None, penalty, weight, bin_width)
    kind = df.schema[pos].dataType
    return runs.select(
        *keys, F.col("seg_first").cast(kind).alias("pos_first"), F.col("seg_last").cast(kind).alias("pos_last"), "n_records", (F.col("seg_last") - F.col("seg_first") + 1).alias("n_bases")
    )
