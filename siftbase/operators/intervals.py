"""Problem 5: continuous periods and gaps of overlapping intervals per entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbase.operators.carry import neighbours, packed, running, with_bin
from siftbase.session import fresh

#: Width of a bin of whole-numbered positions up to 32 bits.
BIN_WIDTH = 1 << 15
#: Rows that a bin should have where its width comes from the data, and bins at most.
BIN_ROWS, MOST_BINS = 4096, 1 << 16
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _ordinal(kind: T.DataType) -> tuple[Callable[[Column], Column], Callable[[Column], Column], bool]:
    """(to a number that keeps every value apart, back, whether values are counted in whole steps) of a type of bounds.

    Steps are 1, a day or a microsecond; decimals and floating-point numbers have none.
    """
    if isinstance(kind, T.IntegralType):
        return (lambda c: c.cast("long")), (lambda c: c.cast(kind)), True
    if isinstance(kind, T.DateType):
        return (lambda c: F.unix_date(c).cast("long")), (lambda c: F.date_from_unix_date(c.cast("int"))), True
    if isinstance(kind, T.TimestampType):
        return (lambda c: F.unix_micros(c)), (lambda c: F.timestamp_micros(c)), True
    if isinstance(kind, T.TimestampNTZType):
        since = lambda c: F.timestamp_diff("MICROSECOND", F.expr(EPOCH), c)
        return since, (lambda c: F.timestamp_add("MICROSECOND", c, F.expr(EPOCH))), True
    if isinstance(kind, (T.DecimalType, T.FractionalType)):
        return (lambda c: c), (lambda c: c.cast(kind)), False
    raise TypeError(f"bounds of type {kind.simpleString()} have no order of positions")


def _data_width(rows: DataFrame) -> float | int:
    """A width that gives bins of about ``BIN_ROWS`` rows over the range of ``_s``, and at most ``MOST_BINS`` bins."""
    finite = F.when(F.abs(F.col("_s").cast("double")) < F.lit(float("inf")), F.col("_s").cast("double"))
    low, high, n = rows.agg(F.min(finite), F.max(finite), F.count(F.lit(1))).first()
    bins = max(1, min(MOST_BINS, n // BIN_ROWS))
    return max((high - low) / bins, 1e-300) if n and low is not None and high > low else 1.0


def merge_intervals(
    df: DataFrame,
    keys: list[str],
    first: str,
    second: str,
    bin_width: float | None = None,
    touch: int | None = None,
) -> DataFrame:
    """Merged periods and the gaps between them.

    Returns ``keys``, ``kind`` (``merged`` or ``gap``), ``first``, ``second`` as
    named and typed in the input; all other columns are left out. Sorts by start
    per entity, compares each start with the running maximum of the ends before
    it, labels the islands and aggregates them; a gap is what lies between that
    maximum and an island's start.

    Bounds keep their type. Whole numbers, dates (in days) and timestamps (in
    microseconds) have steps: both ends are included, intervals with fewer than
    ``touch`` (1) steps between them are continuous, and a gap begins a step
    after a period and ends a step before the next. Decimals and floating-point
    numbers have no steps: intervals that share a bound are continuous
    (``touch`` 0), and a gap has the bounds of the periods around it.

    The running maximum goes over (entity, bin of the start) with the maximum of
    earlier bins carried in, so that an entity with a third of all rows spreads
    over its bins; equal starts are reduced to the longest before any sort. Up to
    32 bits a bin has ``BIN_WIDTH`` positions; other types take a width from the
    range and number of the rows, which is one pass more over the bounds.

    Defined cases: rows with a null or NaN bound or with first > second are left
    out; a null key is an entity of its own; repeated, nested and equal intervals
    merge; infinite bounds are bounds like others; an empty table gives no rows.
    """
    n, kind = ["_key"], df.schema[first].dataType
    to_number, back, steps = _ordinal(kind)
    step = 1 if steps else 0
    touch = step if touch is None else touch
    rows = df.select(packed(keys).alias("_key"), to_number(F.col(first)).alias("_s"), to_number(F.col(second).cast(kind)).alias("_e"))
    rows = rows.where(F.col("_s").isNotNull() & F.col("_e").isNotNull() & (F.col("_s") <= F.col("_e")))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        rows = rows.where(~F.isnan("_s") & ~F.isnan("_e"))
    rows = rows.groupBy(*n, "_s").agg(F.max("_e").alias("_e"))
    short = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType))
    if short or isinstance(bin_width, int) and steps:
        rows = with_bin(rows, "_s", bin_width or BIN_WIDTH)
    else:
        number = F.col("_s").cast("double") / F.lit(float(bin_width or _data_width(rows)))
        rows = rows.withColumn("_bin", F.floor(F.greatest(F.least(number, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long"))
    rows = running(rows, n, [F.col("_s")], F.col("_e"), "_before", "max", inclusive=False)
    opens = F.col("_before").isNull() | (F.col("_s") > F.col("_before") + F.lit(touch))
    rows = running(rows, n, [F.col("_s")], F.when(opens, F.col("_s")), "_island", "max")
    merged = rows.groupBy(*n, "_island").agg(F.max("_e").alias("_to"), F.max(F.when(F.col("_s") == F.col("_island"), F.col("_before"))).alias("_gap"))
    periods = F.array(
        F.struct(F.lit("merged").alias("kind"), back(F.col("_island")).alias("a"), back(F.col("_to")).alias("b")),
        F.when(
            F.col("_gap").isNotNull(),
            F.struct(F.lit("gap").alias("kind"), back(F.col("_gap") + step).alias("a"), back(F.col("_island") - step).alias("b")),
        ),
    )
    out = merged.select(*n, F.explode(F.array_compact(periods)).alias("_p"))
    return out.select(
        *[F.col("_key")[k].alias(k) for k in keys],
        F.col("_p.kind").alias("kind"),
        F.col("_p.a").alias(first),
        F.col("_p.b").alias(second),
    )


def previous_gap(df: DataFrame, keys: list[str], pos: str, origin: str | None = None, width: int = BIN_WIDTH) -> DataFrame:
    """Add ``gap_first``/``gap_second``, the stretch between a row and the row before it along its key.

    Windows cover (key, bin of positions); the row before a bin's first comes
    from a summary row per bin. Rows without a position have no stretch, and a
    null key is one of its own.
    """
    key, at = fresh("_key", df), fresh("_at", df)
    placed = df.withColumn(key, packed(keys)).withColumn(at, F.col(pos).cast("long"))
    prev = neighbours(placed.where(F.col(at).isNotNull()), [key], at, [], width)
    kind = df.schema[pos].dataType
    before = F.col(f"_prev.{at}").cast(kind) + F.lit(1).cast(kind)
    start = F.coalesce(before, F.col(origin)) if origin else before
    out = prev.withColumn("gap_first", start).withColumn("gap_second", F.col(pos) - F.lit(1).cast(kind)).select(*df.columns, "gap_first", "gap_second")
    none = placed.where(F.col(at).isNull()).select(*df.columns, F.lit(None).cast(kind).alias("gap_first"), F.lit(None).cast(kind).alias("gap_second"))
    return out.unionByName(none)
