"""Greedy segments of nearly constant values along ordered positions, without a task per key.

A segment takes the next row as long as every value stays inside a tolerance
over the whole segment. The tolerance is hereditary (each part of a segment that
is inside it is inside it), so that ``reach(i)``, the first row that can't be in
a segment which begins at row ``i``, says everything: the segments are the chain
first, reach(first), reach(reach(first)), ...

A key isn't one task: its rows are cut into bins of positions. A bin follows its
own chain, and says for each way in which a segment of the bin before can end
inside it (``steps``) where that would be and where the bin's own chain is met
again. A pass over these summaries in order of the bins, one row per bin and
constant memory, tells each bin which step is the true one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftbase.session import cut

#: Rows that the kernel takes at once.
CHUNK = 1 << 16


class Tolerance:
    """Values are near-identical while ``highest - lowest <= max(absolute, relative * lowest)``.

    A ``relative`` given as a fraction (numerator, denominator) compares whole numbers exactly.
    """

    def __init__(self, absolute: float = 3, relative: float | tuple[int, int] = (3, 10)):
        self.absolute = absolute
        self.num, self.den = relative if isinstance(relative, tuple) else (relative, 1)

    def holds(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over the last axis, the values of one row."""
        return (self.den * (hi - lo) <= np.maximum(self.den * self.absolute, self.num * lo)).all(axis=-1)


def reaches(v: np.ndarray, forced: np.ndarray, tol: Tolerance) -> np.ndarray:
    """For each row the first later row that can't be in its segment; ``forced`` marks rows that must begin one."""
    n = len(v)
    limit = np.full(n, n)
    at = np.flatnonzero(forced)
    at = at[at > 0]
    if len(at):
        k = np.searchsorted(at, np.arange(n), side="right")
        limit = np.where(k < len(at), at[np.minimum(k, len(at) - 1)], n)
    lows, highs = [v], [v]
    while True:  # tables of segments of 1, 2, 4, ... rows, as far as any is inside the tolerance
        half = 1 << (len(lows) - 1)
        if n <= 2 * half - 1:
            break
        lo = np.minimum(lows[-1][: n - 2 * half + 1], lows[-1][half : n - half + 1])
        hi = np.maximum(highs[-1][: n - 2 * half + 1], highs[-1][half : n - half + 1])
        if not (tol.holds(lo, hi) & (np.arange(len(lo)) + 2 * half <= limit[: len(lo)])).any():
            break
        lows.append(lo)
        highs.append(hi)
    end = np.arange(n) + 1
    lo, hi = v.copy(), v.copy()
    for k in range(len(lows) - 1, -1, -1):
        rows = np.flatnonzero(end + (1 << k) <= limit)
        if not len(rows):
            continue
        to = end[rows]
        new_lo, new_hi = np.minimum(lo[rows], lows[k][to]), np.maximum(hi[rows], highs[k][to])
        ok = tol.holds(new_lo, new_hi)
        rows = rows[ok]
        lo[rows], hi[rows] = new_lo[ok], new_hi[ok]
        end[rows] += 1 << k
    return end


def chain(reach: np.ndarray) -> np.ndarray:
    """The rows 0, reach(0), reach(reach(0)), ... as a mask, all found in doubling steps."""
    n = len(reach)
    marks, jump = np.zeros(n + 1, bool), np.append(reach, n)
    marks[0] = True
    while True:
        marks[jump[np.flatnonzero(marks)]] = True
        if (jump == n).all():
            return marks[:n]
        jump = jump[jump]


def changed(col: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it, null being a value."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differ, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def whole_groups(keys: int):
    """Tables of whole groups (equal in the first ``keys`` columns, which lie together) of about CHUNK rows from Arrow batches."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) < CHUNK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            new = np.flatnonzero(np.logical_or.reduce([changed(c.chunk(0)) for c in rows.columns[:keys]]))
            if not len(new):
                held = rows.to_batches()
                continue
            at = int(new[-1]) + 1  # the last group may go on
            held = rows.slice(at).combine_chunks().to_batches()
            yield rows.slice(0, at).combine_chunks()
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    return gather


LAST = pa.struct([("start", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
STEP = pa.struct([
    ("before", pa.int64()), ("forced", pa.bool_()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
    ("meets", pa.int32()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("last", LAST),
])
RUN_SQL = "starts array<bigint>, ends array<bigint>"
LAST_SQL = "struct<start:bigint,lo:array<double>,hi:array<double>>"
BIN_SQL = (
    f"left_open boolean, right_open boolean, last_pos bigint, {RUN_SQL}, last {LAST_SQL}, steps array<struct<before:bigint,forced:boolean,"
    f"lo:array<double>,hi:array<double>,meets:int,starts:array<bigint>,ends:array<bigint>,last:{LAST_SQL}>>"
)


def _steps(pos: np.ndarray, to: np.ndarray, v: np.ndarray, reach: np.ndarray, marks: np.ndarray, s: int, e: int) -> list[dict]:
    """The ways in which a segment of the bin before can end in rows s..e-1, in order."""
    r = reach[s]
    lo, hi = np.minimum.accumulate(v[s:r]), np.maximum.accumulate(v[s:r])
    new = np.ones(r - s, bool)
    new[1:] = (lo[1:] != lo[:-1]).any(axis=1) | (hi[1:] != hi[:-1]).any(axis=1)
    own_before = np.cumsum(marks[s:e])
    out = []
    for k in [*(s + np.flatnonzero(new)), *([r] if r < e else [])]:
        p, own = int(k), []
        while p < e and not marks[p]:
            own.append((int(pos[p]), int(to[reach[p] - 1]), p))
            p = int(reach[p])
        last = None
        if p >= e and own:  # the chain from here doesn't meet the bin's own
            q = own[-1][2]
            last = {"start": own[-1][0], "lo": v[q:e].min(0).tolist(), "hi": v[q:e].max(0).tolist()}
        forced = k == r
        out.append({
            "before": int(to[k - 1]) if k > s else None, "forced": bool(forced), "lo": None if forced else lo[k - s].tolist(), "hi": None if forced else hi[k - s].tolist(),
            "meets": int(own_before[p - s]) - 1 if p < e else None, "starts": [x[0] for x in own], "ends": [x[1] for x in own], "last": last,
        })
    return out


def _solve(rows: pa.Table, keys: int, width: int, zero: int | None, tol: Tolerance) -> pa.RecordBatch:
    """One row per bin from whole bins of rows sorted by keys, bin, position and id. Columns: keys, bin, first, last, forced, id, values."""
    cols = [c.chunk(0) if c.num_chunks else c.combine_chunks() for c in rows.columns]
    n = rows.num_rows
    start = np.ones(n, bool)
    start[1:] = np.logical_or.reduce([changed(c) for c in cols[: keys + 1]]) if n > 1 else []
    pos, to = (c.to_numpy().astype(np.int64) for c in cols[keys + 1 : keys + 3])
    must = cols[keys + 3].to_numpy(zero_copy_only=False)
    ids = cols[keys + 4]
    twice = np.zeros(n, bool)
    if n > 1:
        equal = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        twice[1:] = equal & ~start[1:] & (pos[1:] == pos[:-1])
    keep = np.flatnonzero(~twice)
    pos, to, start, must = pos[keep], to[keep], start[keep], must[keep]
    v = np.stack([c.to_numpy(zero_copy_only=False)[keep] for c in cols[keys + 5 :]], axis=1)
    v = v.astype(np.int64 if np.issubdtype(v.dtype, np.integer) else np.float64)
    forced = start | must
    forced[1:] |= pos[1:] != to[:-1] + 1
    if zero is not None:
        forced[1:] |= (v[1:, zero] == 0) != (v[:-1, zero] == 0)
    reach = reaches(v, forced, tol)
    marks = chain(reach)
    s = np.flatnonzero(start)
    e = np.append(s[1:], len(pos))
    begin = np.flatnonzero(marks)
    first_run = np.searchsorted(begin, s)
    offsets = pa.array(np.append(first_run, len(begin)), pa.int32())
    stop = np.append(begin[1:], len(pos)) - 1
    low = cols[keys].take(pa.array(keep[s])).to_numpy() * width
    left = (pos[s] == low) & ~must[s]
    right = to[e - 1] == low + width - 1
    last, steps = [], []
    for i in range(len(s)):
        a, z = int(s[i]), int(e[i])
        q = int(begin[first_run[i + 1] - 1 if i + 1 < len(s) else -1])
        last.append({"start": int(pos[q]), "lo": v[q:z].min(0).tolist(), "hi": v[q:z].max(0).tolist()} if right[i] else None)
        steps.append(_steps(pos, to, v, reach, marks, a, z) if left[i] else None)
    take = pa.array(keep[s])
    return pa.RecordBatch.from_arrays(
        [
            *[c.take(take) for c in cols[: keys + 1]],
            pa.array(left),
            pa.array(right),
            pa.array(to[e - 1]),
            pa.ListArray.from_arrays(offsets, pa.array(pos[begin])),
            pa.ListArray.from_arrays(offsets, pa.array(to[stop])),
            pa.array(last, LAST),
            pa.array(steps, pa.list_(STEP)),
        ],
        names=[*rows.column_names[: keys + 1], "left_open", "right_open", "last_pos", "starts", "ends", "last", "steps"],
    )


def _true_steps(keys: int, zero: int | None, tol: Tolerance, schema: pa.Schema):
    """Goes through the summaries by key and bin with one open segment as its state."""

    def inside(x: dict, y: dict) -> bool:
        lo, hi = np.minimum(x["lo"], y["lo"]), np.maximum(x["hi"], y["hi"])
        return bool(tol.holds(lo, hi)) and (zero is None or (x["lo"][zero] == 0) == (y["lo"][zero] == 0))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, last_pos, run = (), None, None, None  # run: start, lo, hi; open at the end of the bin ``before``
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[f"_k{i}"] for i in range(keys))
                if run and not (now == key and row["_bin"] == before + 1 and row["left_open"]):
                    out.append((*key, before, None, [run["start"]], [last_pos]))
                    run = None
                starts, ends, meets, last = [], [], None, row["last"]
                if run:
                    step = next((x for x in row["steps"] if x["forced"] or not inside(run, x)), None)
                    if step:
                        starts = [run["start"], *step["starts"]]
                        ends = [last_pos if step["before"] is None else step["before"], *step["ends"]]
                        meets = step["meets"]
                        if meets is None:  # no segment of the bin's own chain stands
                            meets, last = row["n_own"], step["last"]
                            if row["right_open"]:
                                starts, ends = starts[:-1], ends[:-1]
                    else:  # the whole bin goes into the segment
                        step, meets = row["steps"][-1], row["n_own"]
                        last = {"start": run["start"], "lo": np.minimum(run["lo"], step["lo"]), "hi": np.maximum(run["hi"], step["hi"])}
                        if not row["right_open"]:
                            starts, ends = [run["start"]], [row["last_pos"]]
                out.append((*now, row["_bin"], meets, starts, ends))
                run = last if row["right_open"] else None
                key, before, last_pos = now, row["_bin"], row["last_pos"]
            yield rows_of(out)
        if run:
            yield rows_of([(*key, before, None, [run["start"]], [last_pos])])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return walk


def split_at_bins(df: DataFrame, first: str, last: str, width: int, name: str = "_bin") -> DataFrame:
    """Stretches cut at the edges of bins, with their bin."""
    bins = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
    out = df.withColumn(name, F.explode(bins)).withColumn(first, F.greatest(F.col(first), F.col(name) * width))
    return out.withColumn(last, F.least(F.col(last), (F.col(name) + 1) * width - 1))


def tolerant_segments(
    df: DataFrame, keys: list[str], first: str, values: list[str], tolerance: Tolerance, last: str | None = None, id_col: str | None = None,
    zero_splits: str | None = None, forced: Column | None = None, bin_width: int = 1 << 13,
) -> DataFrame:
    """``keys``, ``seg_first``, ``seg_last`` (longs) of the segments of rows at ``first``, or of stretches ``first`` to ``last``.

    A row joins the segment before it if it begins one position after its end,
    isn't ``forced`` to begin one, every value stays inside ``tolerance`` over the
    whole segment, and ``zero_splits``, if given, is 0 in all or in none. Rows are
    shuffled once, by (keys, bin); after that only summaries move.

    Defined cases: rows must have positions and values; null keys are a key of
    their own; rows equal in keys, position and ``id_col`` count once; other rows
    at one position each begin a segment.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    n, zero = len(keys), values.index(zero_splits) if zero_splits else None
    rows = df.select(
        *[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(first).cast("long").alias("_pos"), F.col(last or first).cast("long").alias("_to"),
        (F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)).alias("_must"), (F.col(id_col) if id_col else F.lit(None).cast("long")).alias("_id"),
        *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)],
    )
    if last:
        must = F.col("_must") & (F.col("_pos") == F.col("_from"))
        rows = split_at_bins(rows.withColumn("_from", F.col("_pos")), "_pos", "_to", bin_width).withColumn("_must", must)
    else:
        rows = rows.withColumn("_bin", F.floor(F.col("_pos") / bin_width).cast("long"))
    cols = [*names, "_bin", "_pos", "_to", "_must", "_id", *[f"_v{i}" for i in range(len(values))]]
    same = [*(["_to"] if not last else []), *(["_must"] if forced is None else [])]  # what needn't be shuffled
    rows = rows.select(*cols)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_sql = ", ".join([*(f"{a} {types[a]}" for a in names), "_bin bigint"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(n + 1)(batches):
            yield _solve(t, n, bin_width, zero, tolerance)

    by_bin = rows.drop(*same).repartition(*names, "_bin").sortWithinPartitions(*names, "_bin", "_pos", "_id")
    by_bin = by_bin.withColumns({c: F.col("_pos") if c == "_to" else F.lit(False) for c in same}).select(*cols)
    bins = cut(by_bin.mapInArrow(solve, f"{key_sql}, {BIN_SQL}"))
    edges = bins.where("left_open or right_open").select(*names, "_bin", "left_open", "right_open", "last_pos", "last", "steps", F.size("starts").alias("n_own"))
    ordered = edges.repartition(*(names or [F.lit(0)])).sortWithinPartitions(*names, "_bin")
    fix_sql = f"{key_sql}, meets int, {RUN_SQL}"
    fixes = ordered.mapInArrow(_true_steps(n, zero, tolerance, to_arrow_schema(T._parse_datatype_string(fix_sql))), fix_sql)
    # A bin can have two rows of fixes: its own, and one that closes its last segment.
    fixes = fixes.groupBy(*names, "_bin").agg(
        F.max("meets").alias("meets"), F.flatten(F.collect_list("starts")).alias("more_starts"), F.flatten(F.collect_list("ends")).alias("more_ends")
    )
    right = fixes.select(*[F.col(c).alias(f"_f{c}") for c in [*names, "_bin"]], "meets", "more_starts", "more_ends")
    joined = bins.join(right, reduce(Column.__and__, [bins[c].eqNullSafe(right[f"_f{c}"]) for c in [*names, "_bin"]]), "left")
    own = F.arrays_zip(F.col("starts").alias("starts"), F.col("ends").alias("ends"))
    meets = F.coalesce("meets", F.lit(0))
    stands = F.slice(own, meets + 1, F.greatest(F.size("starts") - meets - F.col("right_open").cast("int"), F.lit(0)))
    more = F.when(F.col("more_starts").isNotNull(), F.arrays_zip(F.col("more_starts").alias("starts"), F.col("more_ends").alias("ends")))
    runs = joined.select(*names, F.explode(F.concat(stands, F.coalesce(more, F.array().cast("array<struct<starts:bigint,ends:bigint>>")))).alias("_r"))
    return runs.select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], F.col("_r.starts").alias("seg_first"), F.col("_r.ends").alias("seg_last"))
