"""Stretches without a variant compressed into blocks of nearly constant depth.

A block grows while depth, reference and variant reads each stay inside the
tolerance over the whole block. Blocks are segments (``segments.py``) over bins
of positions with the open block handed on, so neither a contig nor a stretch of
constant depth is a task or a row; rows may be stretches of positions as the
coverage sweep gives them. Statistics are ordinary aggregates per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbase.config import CallerOptions
from siftbase.operators.carry import neighbours, packed, running
from siftbase.operators.segments import Tolerance, split_at_bins, tolerant_segments
from siftbase.session import cut

WIDTH = 1 << 14
NAMES = ("dp", "rr", "vr")


def _inside(lo: Column, hi: Column, o: CallerOptions) -> Column:
    return hi - lo <= F.greatest(lo * F.lit(float(o.block_rel)), F.lit(float(o.block_abs)))


def nonvariant_blocks(
    rows: DataFrame, keys: list[str], pos: str = "pos", called: str = "called", o: CallerOptions | None = None, last: str | None = None, p: str | None = None
) -> DataFrame:
    """Blocks of positions (``keys``, ``pos``, dp, rr, vr, ``called``), one row per position, or per stretch ``pos`` to ``last`` of equal values.

    Returns ``keys``, block_first, block_last (positions as given, both ends
    included), reason, n_stats and for dp, rr, vr (and the probability ``p``, if
    given) the minimum, maximum, mean and sample standard deviation. Consecutive
    positions are a region; called positions are in no block. A region's last
    base belongs to its last block but not to the statistics, which are 0 where
    nothing else is in the block.

    Defined cases: rows with a null position or value are left out (a null ``p``
    is 0); a null key is one of its own; an empty table gives no rows; of several
    rows at one position the one with the largest values stands; stretches must
    not overlap.
    """
    o = o or CallerOptions()
    values = [*NAMES, *(["p"] if p else [])]
    clean = rows.dropna(subset=[pos, *NAMES, *([last] if last else [])])
    numbers = [*[F.col(c).cast("double").alias(c) for c in NAMES], *([F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias("p")] if p else [])]
    clean = clean.select(packed(keys).alias("_key"), F.col(pos).cast("long").alias("_pos"), F.col(last or pos).cast("long").alias("_to"), F.struct(*numbers).alias("_v"), F.coalesce(F.col(called), F.lit(False)).alias("_called"))
    clean = clean.groupBy("_key", "_pos").agg(F.max(F.struct("_v", "_called", "_to")).alias("_x")).select("_key", "_pos", "_x.*")
    r = neighbours(clean, ["_key"], "_pos", ["_to", "_called"], WIDTH).drop("_bin")
    joined = F.coalesce(F.col("_prev._to") == F.col("_pos") - 1, F.lit(False))
    ends = F.coalesce(F.col("_next._pos") != F.col("_to") + 1, F.lit(True))
    r = cut(r.select("_key", "_pos", "_to", "_called", "_v.*", (~joined | F.col("_prev._called")).alias("_anew"), ends.alias("_ends")))  # needed four times
    free = r.where(~F.col("_called"))
    # A region's last base is in no statistics and breaks nothing.
    body = free.withColumn("_to", F.col("_to") - F.col("_ends").cast("int")).where("_to >= _pos")
    names = [f"_key{i}" for i in range(len(keys))]
    spread = body.select(*[F.col("_key")[k].alias(a) for k, a in zip(keys, names, strict=True)], "_pos", "_to", "_anew", *NAMES)
    segs = tolerant_segments(spread, names, "_pos", list(NAMES), Tolerance(float(o.block_abs), float(o.block_rel)), "_to", zero_splits="dp", forced=F.col("_anew"), bin_width=WIDTH)
    starts = segs.select(F.struct(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)]).alias("_skey"), F.col("seg_first").alias("_spos"), F.floor(F.col("seg_first") / WIDTH).alias("_sbin"))
    placed = split_at_bins(body.drop("_anew", "_ends", "_called"), "_pos", "_to", WIDTH)
    placed = placed.join(starts, (F.col("_key") == F.col("_skey")) & (F.col("_bin") == F.col("_sbin")) & (F.col("_pos") == F.col("_spos")), "left")
    label = running(placed, ["_key"], [F.col("_pos")], F.col("_spos"), "_label", "max")
    n = F.col("_to") - F.col("_pos") + 1
    stats = [x for c in values for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.sum(F.col(c) * n).alias(f"_{c}_sum"), F.sum(F.col(c) * F.col(c) * n).alias(f"_{c}_sq"))]
    b = cut(label.groupBy("_key", "_label").agg(F.max("_to").alias("_end"), F.sum(n).alias("n_stats"), F.min_by(F.struct(*NAMES), F.col("_pos")).alias("_first"), *stats))
    # What lies behind a block says why it ends: a call, the region's last base, or the block that values went out of it for.
    what = lambda df, at, name, v: df.select(F.col("_key").alias("_nkey"), at.alias("_at"), F.lit(name).alias("_what"), v.alias("_nv"))
    none = F.lit(None).cast(b.schema["_first"].dataType)
    tail = free.where("_ends")
    behind = what(r.where("_called"), F.col("_pos"), "blocked", none).unionByName(what(tail, F.col("_to"), "endofregion", none)).unionByName(what(b, F.col("_label"), "values", F.col("_first")))
    b = b.join(behind, (F.col("_key") == F.col("_nkey")) & (F.col("_at") == F.col("_end") + 1), "left")
    lo, hi = (lambda c: F.least(F.col(f"{c}_min"), F.col(f"_nv.{c}"))), (lambda c: F.greatest(F.col(f"{c}_max"), F.col(f"_nv.{c}")))
    reason = F.when(F.col("_what") != "values", F.col("_what")).when((F.col("_nv.dp") == 0) & (F.col("dp_min") > 0), "cov2nocov").when((F.col("_nv.dp") > 0) & (F.col("dp_max") == 0), "nocov2cov")
    for c in NAMES:
        reason = reason.when(~_inside(lo(c), hi(c), o), c)
    b = b.withColumn("reason", reason).withColumn("_end", F.col("_end") + (F.col("_what") == "endofregion").cast("int"))
    k, out = F.col("n_stats"), []
    for c in values:
        total = F.col(f"_{c}_sum")
        sd = F.when(k > 1, F.sqrt(F.greatest((F.col(f"_{c}_sq") - total * total / k) / (k - 1), F.lit(0.0)))).otherwise(0.0)
        kind = "double" if c == "p" else "long"
        out += [F.col(f"{c}_min").cast(kind).alias(f"{c}_min"), F.col(f"{c}_max").cast(kind).alias(f"{c}_max"), (total / k).alias(f"{c}_mean"), sd.alias(f"{c}_sd")]
    kind = rows.schema[pos].dataType
    b = b.select(*[F.col("_key")[k_].alias(k_) for k_ in keys], F.col("_label").cast(kind).alias("block_first"), F.col("_end").cast(kind).alias("block_last"), "reason", "n_stats", *out)
    # A region of one base is a block without statistics.
    alone = tail.where(F.col("_anew") & (F.col("_pos") == F.col("_to")))
    zeros = [F.lit(0).cast(b.schema[c].dataType).alias(c) for c in b.columns if c.endswith(("_min", "_max", "_mean", "_sd"))]
    alone = alone.select(*[F.col("_key")[k_].alias(k_) for k_ in keys], F.col("_pos").cast(kind).alias("block_first"), F.col("_pos").cast(kind).alias("block_last"), F.lit("endofregion").alias("reason"), F.lit(0).cast("long").alias("n_stats"), *zeros)
    return b.unionByName(alone)
