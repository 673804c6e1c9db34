"""Joins by position: overlapping intervals, points in intervals, contigs with targets, known indels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbase.operators.intervals import merge_intervals
from siftbase.session import fresh


def _bins(first: str, last: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int = 1 << 12) -> DataFrame:
    """Inner join of rows whose intervals (both ends included) share a position and whose ``keys`` are equal.

    Both sides are spread over bins of positions and meet in an equi-join on
    (keys, bin); a pair that shares several bins is taken in the first of them,
    so nothing has to be made distinct. Range columns and all further columns of
    the two sides need different names. Null or reversed intervals meet nothing.
    """
    (a, z), (b, y) = left_range, right_range
    lhs = left.where(F.col(a) <= F.col(z)).withColumn("_bin", _bins(a, z, width))
    rhs = right.where(F.col(b) <= F.col(y)).withColumn("_bin", _bins(b, y, width))
    met = lhs.join(rhs, [*keys, "_bin"])
    first_shared = F.floor(F.greatest(F.col(a), F.col(b)) / width)
    return met.where((F.col(a) <= F.col(y)) & (F.col(b) <= F.col(z)) & (F.col("_bin") == first_shared)).drop("_bin")


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, first: str, second: str, out: str = "on_target", width: int = 1 << 12) -> DataFrame:
    """``points`` with ``out``, whether an interval of the same keys covers the point.

    Intervals are merged first, so that at most one covers a point and the join
    never multiplies rows.
    """
    merged = merge_intervals(intervals, keys, first, second).where("kind = 'merged'")
    bin_, a, z = (fresh(x, points) for x in ("_bin", "_a", "_z"))
    ks = {k: fresh(f"_i_{k}", points) for k in keys}
    spread = merged.withColumn(bin_, _bins(first, second, width)).select(*[F.col(k).alias(x) for k, x in ks.items()], bin_, F.col(first).alias(a), F.col(second).alias(z))
    cond = (F.floor(F.col(point) / width) == F.col(bin_)) & (F.col(point) >= F.col(a)) & (F.col(point) <= F.col(z))
    for k, x in ks.items():
        cond = cond & (F.col(k) == F.col(x))
    met = points.join(spread, cond, "left")
    return met.withColumn(out, F.col(a).isNotNull()).drop(bin_, a, z, *ks.values())


def with_targets(contigs: DataFrame, targets: DataFrame) -> DataFrame:
    """Contigs that hold a valid target, in their own order."""
    valid = targets.where("contig is not null and coord_first <= coord_second")
    return contigs.join(valid, "contig", "left_semi")


def with_known(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls (contig, pos, ref, alt) with ``af``, the frequency of the known indel of the same kind, start and bases."""
    k = known.where("contig is not null and pos is not null").groupBy(F.col("contig").alias("_kc"), F.col("key").alias("_kk")).agg(F.max("af").alias("af"))
    keyed = calls.withColumn("_key", known_key(F.col("pos"), F.col("ref"), F.col("alt")))
    return keyed.join(k, (F.col("contig") == F.col("_kc")) & (F.col("_key") == F.col("_kk")), "left").drop("_key", "_kc", "_kk")


def known_key(pos: Column, ref: Column, alt: Column) -> Column:
    """Anchor, kind and length or bases of an indel as text: 123D4, 123IAC."""
    deleted = F.length(ref) - F.length(alt)
    return F.when(deleted > 0, F.concat(pos.cast("string"), F.lit("D"), deleted.cast("string"))).when(
        deleted < 0, F.concat(pos.cast("string"), F.lit("I"), F.substring(alt, F.length(ref) + 1, -deleted))
    )
