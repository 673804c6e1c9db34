"""Running aggregates over one long ordered key without a task per key.

A window ordered over a whole key sorts every row of that key in one task. Here
rows are windowed inside (key, bin) and each bin gets the aggregate of the bins
before it, which comes from one summary row per bin. A key then costs as many
tasks as it has bins, and the pass over the summaries has at most
2**31 / width rows per key as positions are 32-bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, None)}


def with_bin(df: DataFrame, order: str, width: int, name: str = "_bin") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(order) / F.lit(width)).cast("long"))


def packed(keys: list[str]) -> Column:
    """The keys as one struct, which is never null and in which null equals null.

    Joins on it are plain equi-joins, so that they and the windows and
    aggregations around them share one partitioning by (key, bin).
    """
    return F.struct(*keys)


def _equal(left: DataFrame, right: DataFrame, columns: list[str], prefix: str) -> Column:
    """Equality of the columns, the last of them the bin, with null equal to null."""
    conds = [left[k] == right[f"{prefix}{i}"] if not left.schema[k].nullable or i == len(columns) - 1 else left[k].eqNullSafe(right[f"{prefix}{i}"]) for i, k in enumerate(columns)]
    return reduce(Column.__and__, conds)


def running_many(df: DataFrame, keys: list[str], order: list[Column], specs: list[tuple[Column, str, str, bool]], bin_col: str = "_bin") -> DataFrame:
    """Add for each (value, out, how, inclusive) the aggregate of the value over the rows of the key up to this one.

    ``df`` has ``bin_col``, non-decreasing along ``order``. Null values are
    skipped; before the first value ``out`` is null (0 for sums). Without
    ``inclusive`` the row itself is left out. All of them share one summary per
    bin, one join and one sort.
    """
    for i, (value, *_) in enumerate(specs):
        df = df.withColumn(f"_value{i}", value)
    per_bin = df.groupBy(*keys, bin_col).agg(*[AGGREGATES[how][0](f"_value{i}").alias(f"_of_bin{i}") for i, (_, _, how, _) in enumerate(specs)])
    before = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bin.select(
        *[F.col(k).alias(f"_c_{i}") for i, k in enumerate([*keys, bin_col])],
        *[AGGREGATES[how][0](f"_of_bin{i}").over(before).alias(f"_carry{i}") for i, (_, _, how, _) in enumerate(specs)],
    )
    joined = df.join(carry, _equal(df, carry, [*keys, bin_col], "_c_"), "left").drop(*[f"_c_{i}" for i in range(len(keys) + 1)])
    here = Window.partitionBy(*keys, bin_col).orderBy(*order)
    outs = {}
    for i, (_, out, how, inclusive) in enumerate(specs):
        agg, combine = AGGREGATES[how]
        local = agg(f"_value{i}").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
        if combine is None:
            outs[out] = F.coalesce(F.col(f"_carry{i}"), F.lit(0)) + F.coalesce(local, F.lit(0))
        else:
            outs[out] = combine(F.col(f"_carry{i}"), local)
    return joined.withColumns(outs).drop(*[f"_{x}{i}" for x in ("value", "carry") for i in range(len(specs))])


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, how: str = "max", bin_col: str = "_bin", inclusive: bool = True) -> DataFrame:
    """running_many of one value."""
    return running_many(df, keys, order, [(value, out, how, inclusive)], bin_col)


def neighbours(df: DataFrame, keys: list[str], order: str, columns: list[str], width: int, tie: str | None = None) -> DataFrame:
    """Add ``_prev`` and ``_next``, the rows before and after (as structs of ``order`` and ``columns``) along the whole key.

    Windows cover (key, bin); the rows beyond a bin's ends come from one summary
    row per bin. ``order`` is unique in a key, or with ``tie``, the first of the columns.
    """
    rows = with_bin(df, order, width).withColumn("_row", F.struct(order, *[c for c in columns if c != order]))
    per_bin = rows.groupBy(*keys, "_bin").agg(F.min("_row").alias("_head"), F.max("_row").alias("_tail"))
    along = Window.partitionBy(*keys).orderBy("_bin")
    ends = per_bin.select(
        *[F.col(k).alias(f"_e_{i}") for i, k in enumerate([*keys, "_bin"])],
        F.lag("_tail").over(along).alias("_before"), F.lead("_head").over(along).alias("_after"),
    )
    here = Window.partitionBy(*keys, "_bin").orderBy(order, *([tie] if tie else []))
    out = rows.join(ends, _equal(rows, ends, [*keys, "_bin"], "_e_"), "left")
    out = out.withColumn("_prev", F.coalesce(F.lag("_row").over(here), "_before")).withColumn("_next", F.coalesce(F.lead("_row").over(here), "_after"))
    return out.drop("_row", "_before", "_after", *[f"_e_{i}" for i in range(len(keys) + 1)])


__all__ = ["neighbours", "packed", "running", "running_many", "with_bin"]
