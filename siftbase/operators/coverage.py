"""Interval coverage as a sweep over +1/-1 rows; no row per base, no dense arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftbase.operators.carry import packed, running_many, with_bin

BIN = 1 << 15


def _deltas(intervals: DataFrame, keys: list[str], weights: list[str], first: str, last: str) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col(first).cast("long").alias("pos"), F.lit(1).alias("s")), F.struct((F.col(last) + 1).cast("long").alias("pos"), F.lit(-1).alias("s"))))
    rows = intervals.where(F.col(first) <= F.col(last)).select(*keys, *weights, ends.alias("_e"))
    return rows.select(*keys, F.col("_e.pos").alias("pos"), *[(F.col(w) * F.col("_e.s")).alias(w) for w in weights])


def _sweep(deltas: DataFrame, keys: list[str], weights: list[str], cap: int | None, extra: list | None = None) -> DataFrame:
    summed = deltas.groupBy(*keys, "pos").agg(*[F.sum(w).alias(w) for w in weights], *(extra or []))
    rows = with_bin(summed, "pos", BIN)
    rows = running_many(rows, keys, [F.col("pos")], [(F.col(w), f"_sum_{w}", "sum", True) for w in weights])
    depth = [(F.least(F.col(f"_sum_{w}"), F.lit(cap)) if cap else F.col(f"_sum_{w}")).cast("long").alias(w) for w in weights]
    return rows.select(*[c for c in rows.columns if c not in weights and not c.startswith("_sum_")], *depth)


def coverage_runs(intervals: DataFrame, keys: list[str], weights: list[str], first: str = "first", last: str = "last", cap: int | None = 16383) -> DataFrame:
    """``keys``, ``first``, ``last`` and the summed ``weights`` of each stretch of constant coverage above 0.

    Cumulative sums carry over from bin to bin, so that a contig isn't a task.
    Intervals include both ends; null or reversed ones count nowhere.
    """
    names, keys = keys, ["_key"]
    intervals = intervals.withColumn("_key", packed(names))
    depth = _sweep(_deltas(intervals, keys, weights, first, last), keys, weights, cap)
    # the next change: inside the bin, or the first one of a later bin
    bins = depth.groupBy(*keys, "_bin").agg(F.min("pos").alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.select(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_nb"), F.lead("_first").over(later).alias("_next_bin"))
    cond = (depth["_key"] == bins["_n0"]) & (depth["_bin"] == bins["_nb"])
    here = Window.partitionBy(*keys, "_bin").orderBy("pos")
    out = depth.join(bins, cond, "left").withColumn("_to", F.coalesce(F.lead("pos").over(here), F.col("_next_bin")) - 1)
    some = F.lit(False)
    for w in weights:
        some = some | (F.col(w) != 0)
    return out.where(some & F.col("_to").isNotNull()).select(*[F.col("_key")[k].alias(k) for k in names], F.col("pos").alias("first"), F.col("_to").alias("last"), *weights)


def coverage_at(intervals: DataFrame, points: DataFrame, keys: list[str], weights: list[str], point: str = "pos", cap: int | None = 16383) -> DataFrame:
    """``keys``, ``point`` and the coverage there, 0 where nothing lies over it.

    The points take part in the sweep as rows of weight 0, so there is no join of
    sites with coverage at all.
    """
    names, keys = keys, ["_key"]
    intervals, points = intervals.withColumn("_key", packed(names)), points.withColumn("_key", packed(names))
    here = points.select(*keys, F.col(point).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(w) for w in weights], F.lit(True).alias("_is")).distinct()
    deltas = _deltas(intervals, keys, weights, "first", "last").withColumn("_is", F.lit(False))
    swept = _sweep(deltas.unionByName(here), keys, weights, cap, [F.max("_is").alias("_is")])
    return swept.where("_is").select(*[F.col("_key")[k].alias(k) for k in names], F.col("pos").cast("int").alias(point), *weights)
