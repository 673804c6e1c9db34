"""Problem 4: percentiles per group of very large numeric columns by distributed multi-select.

``summarise`` turns values into mergeable summaries per (group, part), a part
being a day or a file: sorted distinct values with counts. ``combine`` joins
summaries of other days or runs to them; no summary is ever taken apart.
``multi_select`` finds order statistics over any set of summaries: each summary
proposes the median of its values still in question, the weighted median of the
proposals becomes the group's pivot, all summaries count what is below, at and
above it, and the range that can't hold the wanted rank is discarded; repeated
per group and percentile until found. A task puts the proposals of
its summaries together first, so that at least an eighth of what is in question
goes each round: rounds grow with the logarithm of the number of distinct
values, and each moves a few numbers per task and group, never the values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftbase.operators.segments import changed
from siftbase.session import cut, fresh

#: Values in one row of a summary; a (group, part) with more takes several rows.
ROW_VALUES = 4096
#: Groups times percentiles up to which the search's state is broadcast.
BROADCAST_STATE = 100_000

SUMMARY = "values array<double>, below array<bigint>"
STATE = ["_q", "rank", "lo", "hi", "pivot", "done"]
VOTE = "n bigint, _q double, rank bigint, lo double, hi double, pivot double, done boolean, side int, x double, weight bigint, less bigint, upto bigint, live bigint"


def _bucket(value: Column, relative_error: float | None) -> Column:
    if not relative_error:
        return value
    gamma = math.log1p(2 * relative_error / (1 - relative_error))
    size = F.exp(F.round(F.log(F.abs(value)) / gamma) * gamma)
    return F.when(value == 0, F.lit(0.0)).when(F.abs(value) == F.lit(float("inf")), value).otherwise(F.signum(value) * size)


def summarise(df: DataFrame, group: str, value: str, part: str, relative_error: float | None = None) -> DataFrame:
    """Mergeable summaries: ``group``, ``part``, ``values`` (sorted), ``below`` (running counts).

    Exact for columns with few distinct values (depths, qualities). With
    ``relative_error`` values are first rounded to geometric buckets, so that a
    summary has at most log(range) / error entries whatever the number of rows.

    Defined cases: null and NaN values are left out; infinite ones are values
    like others; a null group or part is one of its own; an empty table gives no
    summaries.
    """
    x = F.col(value).cast("double")
    counts = (
        df.where(x.isNotNull() & ~F.isnan(x))
        .groupBy(F.col(group).alias("_g"), F.col(part).alias("_part"), _bucket(x, relative_error).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # Small parts lie together, and one too large for a task is split; a part of it is a summary row like any.
    ordered = counts.hint("rebalance", "_g", "_part").sortWithinPartitions("_g", "_part", "_x")
    types = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    packed = ordered.mapInArrow(_pack, f"_g {types['_g']}, _part {types['_part']}, {SUMMARY}")
    return packed.withColumnsRenamed({"_g": group, "_part": part})


def combine(*summaries: DataFrame) -> DataFrame:
    """Summaries of several days, files or runs as one."""
    return reduce(DataFrame.unionByName, summaries)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:  # a (group, part) that goes on in the next batch simply takes another row
        if not b.num_rows:
            continue
        new = np.ones(b.num_rows, bool)
        new[1:] = changed(b.column(0)) | changed(b.column(1))
        at = np.flatnonzero(new)
        since = np.arange(b.num_rows) - np.repeat(at, np.diff(np.append(at, b.num_rows)))
        at = np.flatnonzero(new | (since % ROW_VALUES == 0))
        n = b.column(3).to_numpy()
        total = np.cumsum(n)
        start = np.repeat(total[at] - n[at], np.diff(np.append(at, b.num_rows)))
        offsets = pa.array(np.append(at, b.num_rows), pa.int32())
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), pa.ListArray.from_arrays(offsets, b.column(2)), pa.ListArray.from_arrays(offsets, pa.array(total - start))],
            names=["_g", "_part", "values", "below"],
        )


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a batch of summaries says of each open percentile: how many values lie below and up to the pivot, and the medians of what is left on either side of it.

    Columns: group, n, then by percentile q, rank, lo, hi, pivot, done (bounds are
    excluded, NaN is none), and values, below. Side 0 has the counts and the
    number of distinct values in question, sides 1 and 2 the proposals below and
    above the pivot. Before there is a pivot, side 1 proposes for the whole range.
    The batch's proposals for one percentile become their weighted median.
    """
    for b in batches:
        groups, sizes, qs, ranks, los, his, pivots, dones = (b.column(i).to_pylist() for i in range(8))
        at: dict[tuple, int] = {}
        counts: dict[tuple, list[int]] = {}
        votes: dict[tuple, list[tuple[float, int]]] = {}
        for i, (x, below) in enumerate(_lists(b)):
            lo, hi, pivot = np.array(los[i]), np.array(his[i]), np.array(pivots[i])
            s = np.where(np.isnan(lo), 0, np.searchsorted(x, lo, "right"))
            e = np.where(np.isnan(hi), len(x), np.searchsorted(x, hi, "left"))
            none = np.isnan(pivot)
            a = np.where(none, e, np.searchsorted(x, pivot, "left"))
            z = np.where(none, e, np.searchsorted(x, pivot, "right"))
            upto = np.append(0, below)
            for k, done in enumerate(dones[i]):
                key = (groups[i], k)
                at.setdefault(key, i)
                of = counts.setdefault(key, [0, 0, 0])
                if done:
                    continue
                for j, v in enumerate((upto[a[k]], upto[z[k]], e[k] - s[k])):
                    of[j] += int(v)
                for side, p, r in ((1, s[k], a[k]), (2, z[k], e[k])):
                    if p < r:
                        weight = int(upto[r] - upto[p])
                        votes.setdefault((*key, side), []).append((float(x[np.searchsorted(below, upto[p] + (weight + 1) // 2, "left")]), weight))
        out = []
        for (g, k), i in at.items():
            same = (i, sizes[i], qs[i][k], ranks[i][k], los[i][k], his[i][k], pivots[i][k], dones[i][k])
            out.append((*same, 0, np.nan, 0, *counts[g, k]))
            for side in (1, 2):
                if proposed := sorted(votes.get((g, k, side), ())):
                    w = np.cumsum([v for _, v in proposed])
                    out.append((*same, side, proposed[int(np.searchsorted(w, (w[-1] + 1) // 2, "left"))][0], int(w[-1]), 0, 0, 0))
        rows, *cols = zip(*out, strict=True) if out else ([],) * 14
        kinds = [pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 3, pa.bool_(), pa.int32(), pa.float64(), *[pa.int64()] * 4]
        names = ["_g", "n", "_q", "rank", "lo", "hi", "pivot", "done", "side", "x", "weight", "less", "upto", "live"]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=names)


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries without the values that no open percentile asks for; the one before each range stays, as it says how many came before."""
    for b in batches:
        los, his, dones = (b.column(i).to_pylist() for i in (1, 2, 3))
        values, belows, take = [], [], []
        for i, (x, below) in enumerate(_lists(b)):
            open_ = ~np.array(dones[i])
            lo, hi = np.array(los[i])[open_], np.array(his[i])[open_]
            s = np.where(np.isnan(lo), 0, np.searchsorted(x, lo, "right"))
            e = np.where(np.isnan(hi), len(x), np.searchsorted(x, hi, "left"))
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, np.maximum(s - 1, 0), 1)
            np.add.at(edge, np.maximum(e, np.maximum(s - 1, 0)), -1)
            keep = np.cumsum(edge[:-1]) > 0
            if keep.any():
                take.append(i)
                values.append(x[keep])
                belows.append(below[keep])
        offsets = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(take, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(join(values, np.float64))), pa.ListArray.from_arrays(offsets, pa.array(join(belows, np.int64)))],
            names=["_g", "values", "below"],
        )


def _lists(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two list columns at the end, row by row."""
    one, two = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
    x, y = one.values.to_numpy(), two.values.to_numpy()
    o, p = one.offsets.to_numpy(), two.offsets.to_numpy()
    for i in range(b.num_rows):
        yield x[o[i] : o[i + 1]], y[p[i] : p[i + 1]]


def multi_select(summaries: DataFrame, group: str, quantiles: list[float]) -> DataFrame:
    """``group``, ``quantile``, ``value``, ``n``: the smallest value with at least quantile * n values up to it.

    Exact over the summaries, whose own error ``summarise`` bounds. The state of
    the search has a row per group and percentile; it stays a table and is
    broadcast only up to ``BROADCAST_STATE`` rows. A round goes through each
    summary once for all percentiles: it counts around the pivots and proposes
    the next ones on both sides, as the counts say only when they are summed
    which side goes on. When less than a quarter of the values is still in question,
    the summaries are written anew without the rest.

    Defined cases: groups without a value have no rows; quantile 0 is the
    smallest value; ties count each; infinite values are values like others.
    """
    if not quantiles or any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles must lie in [0, 1]")
    parts = cut(summaries.select(F.col(group).alias("_g"), "values", "below"))
    kind = parts.schema["_g"].dataType.simpleString()
    nan = F.lit(float("nan"))
    begin = lambda q: F.struct(
        F.lit(q).alias("_q"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))).cast("long").alias("rank"),
        nan.alias("lo"), nan.alias("hi"), nan.alias("pivot"), F.lit(False).alias("done"), F.col("live").alias("live"),
    )
    sizes = parts.groupBy("_g").agg(F.sum(F.element_at("below", -1)).alias("n"), F.sum(F.size("values")).cast("long").alias("live"))
    state = cut(sizes.select("_g", "n", F.array(*[begin(float(q)) for q in dict.fromkeys(quantiles)]).alias("s")))
    near = F.broadcast if state.limit(BROADCAST_STATE + 1).count() <= BROADCAST_STATE else (lambda x: x)
    is_open = F.exists("s", lambda x: ~x["done"])
    live = F.aggregate(F.filter("s", lambda x: ~x["done"]), F.lit(0).cast("long"), lambda t, x: t + x["live"])
    found, kept = [], None
    while True:
        left = state.where(is_open).agg(F.count(F.lit(1)).alias("n"), F.sum(live).alias("live")).first()
        found.append(state.where(~is_open))
        if not left["n"]:
            break
        by_group = near(state.where(is_open).select(F.col("_g").alias("_sg"), "n", *[F.col(f"s.{c}").alias(c) for c in STATE]))
        beside = parts.join(by_group, F.col("_g").eqNullSafe(F.col("_sg")))
        kept = kept or left["live"]
        if 4 * left["live"] < kept:
            kept = left["live"]
            parts = cut(beside.select("_g", "lo", "hi", "done", "values", "below").mapInArrow(_trim, f"_g {kind}, {SUMMARY}"))
            beside = parts.join(by_group, F.col("_g").eqNullSafe(F.col("_sg")))
        votes = beside.select("_g", "n", *STATE, "values", "below").mapInArrow(_round, f"_g {kind}, {VOTE}")
        votes = votes.repartition("_g")  # a few rows per task and percentile; all that follows stays in this partitioning
        all_ = Window.partitionBy("_g", "_q", "side")
        votes = votes.withColumn("_upto", F.sum("weight").over(all_.orderBy("x", "weight"))).withColumn("_all", F.sum("weight").over(all_))
        median = lambda side: F.min(F.when((F.col("side") == side) & (2 * F.col("_upto") >= F.col("_all")), F.col("x")))
        same = [F.max(c).alias(c) for c in ("n", "rank", "lo", "hi", "pivot", "done")]
        step = votes.groupBy("_g", "_q").agg(*same, *[F.sum(c).alias(c) for c in ("less", "upto", "live")], median(1).alias("lower"), median(2).alias("upper"))
        done, first, low, high = F.col("done"), F.isnan("pivot"), F.col("rank") > F.col("upto"), F.col("rank") <= F.col("less")
        new = F.struct(
            "_q", "rank",
            F.when(~done & ~first & low, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
            F.when(~done & ~first & high, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(done, F.col("pivot")).when(first, F.col("lower")).when(low, F.col("upper")).when(high, F.col("lower")).otherwise(F.col("pivot")).alias("pivot"),
            (done | (~first & ~low & ~high)).alias("done"), "live",
        )
        state = cut(step.groupBy("_g").agg(F.max("n").alias("n"), F.collect_list(new).alias("s")))  # as many as there are percentiles
    out = reduce(DataFrame.unionByName, found).select("_g", "n", F.explode("s").alias("s"))
    return out.select(F.col("_g").alias(group), F.col("s._q").alias("quantile"), F.col("s.pivot").alias("value"), "n")


def above_median(df: DataFrame, medians: DataFrame, group: str, value: str, times: float) -> DataFrame:
    """Rows of ``df`` whose value is more than ``times`` the median of their group (from multi_select)."""
    g, median = fresh("_mg", df), fresh("_median", df)
    m = medians.select(F.col(group).alias(g), F.col("value").alias(median))
    if m.limit(BROADCAST_STATE + 1).count() <= BROADCAST_STATE:
        m = F.broadcast(m)
    return df.join(m, F.col(group).eqNullSafe(F.col(g))).where(F.col(value) > F.lit(times) * F.col(median)).drop(g, median)
