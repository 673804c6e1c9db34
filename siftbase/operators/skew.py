"""Problem 2: results per key where a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbase.session import fresh

#: Items a frequent-items sketch reports at most; the heavy side's size bound.
MOST_HEAVY = 1024


def heavy_candidates(df: DataFrame, key: str, share: float, tracked: int = 1 << 13) -> tuple[DataFrame, int]:
    """Keys among which are all that hold at least ``share`` of the rows of ``df``, at most ``MOST_HEAVY``, and the number of rows.

    A mergeable frequent-items sketch (built per partition, merged by key-free
    partial aggregation) proposes them; it never misses a key above
    1/``tracked`` of the rows, and ``tracked`` is far above 1/``share``. Null is
    never a candidate; null rows count in the number.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    most = min(MOST_HEAVY, int(2 / share) + 8)
    if most < 1 / share:
        raise ValueError(f"share {share} asks for more than {MOST_HEAVY} keys")
    sketch = F.expr(f"approx_top_k(`{key}`, {most}, {max(tracked, most * 8)})").alias("top")
    found = df.agg(F.count(F.lit(1)).alias("n"), sketch).first()
    items = [r["item"] for r in found["top"] or [] if r["item"] is not None]
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(x,) for x in items], f"`{key}` {kind}"), found["n"]


def heavy_keys(df: DataFrame, key: str, share: float, tracked: int = 1 << 13) -> tuple[DataFrame, int]:
    """Keys that hold at least ``share`` of all rows of ``df``, exactly, with ``n_rows``, and the number of rows.

    The candidates of the sketch, few enough to be broadcast, are counted exactly.
    """
    candidates, total = heavy_candidates(df, key, share, tracked)
    counted = df.select(key).join(F.broadcast(candidates), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") >= F.lit(share) * F.lit(float(total))), total


def split_apply(
    df: DataFrame,
    key: str,
    heavy: DataFrame,
    on_heavy: Callable[[DataFrame], DataFrame],
    on_light: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``on_heavy`` on the rows of the heavy keys, ``on_light`` on all others, then the union.

    ``heavy`` has at most ``MOST_HEAVY`` rows (see heavy_keys). Rows with a null key are light.
    """
    name = fresh("_heavy_key", df)
    keys = F.broadcast(heavy.select(F.col(key).alias(name)))
    cond = F.col(key) == F.col(name)
    return on_heavy(df.join(keys, cond, "left_semi")).unionByName(on_light(df.join(keys, cond, "left_anti")))


def skew_totals(df: DataFrame, key: str, share: float, aggs: list[Column], columns: list[str] | None = None) -> tuple[DataFrame, int]:
    """One row of ``aggs`` per key, without a task per heavy key, and the number of rows of ``df``.

    Rows of the candidates of the sketch, with all keys that hold at least
    ``share`` among them, meet the broadcast candidates where they lie and are
    aggregated there before anything moves; the rows of all other keys take the
    ordinary shuffle by key; then the union. The exact counts come out of it, so
    candidates need no count of their own.

    Defined cases: null is a key of its own among the light ones; a table
    without a heavy key is an ordinary aggregation; an empty table gives no rows.
    """
    heavy, total = heavy_candidates(df, key, share)
    rows = df.select(*dict.fromkeys([key, *(columns or [])]))
    return split_apply(
        rows, key, heavy,
        lambda x: x.groupBy(key).agg(*aggs),
        lambda x: x.repartition(key).groupBy(key).agg(*aggs),
    ), total


def skew_join(
    facts: DataFrame,
    dims: DataFrame,
    key: str,
    share: float = 0.01,
    how: str = "inner",
    dim_rows: int = 100_000,
    heavy: DataFrame | None = None,
    salted_rows: int = 500_000,
) -> DataFrame:
    """Join ``facts`` with ``dims`` on ``key`` without a task per heavy key.

    The dimension rows of heavy keys are broadcast, if there are at most
    ``dim_rows`` of them, and meet the facts where these lie; all other keys
    take the ordinary shuffle. Heavy keys with more dimension rows than may be
    broadcast are salted: their facts spread over so many salts that one has
    about ``salted_rows`` of them, each dimension row is there once per salt, and
    they meet by shuffle. ``heavy`` gives the keys (and ``n_rows``, their facts)
    if they are known; else ``heavy_keys`` finds them.

    A salt is a hash of the fact's row and its partition: a task that runs again
    gives the same, and many equal rows, which lie in many partitions, spread too.

    Defined cases: null keys match nothing (kept by ``left``); a table without
    a heavy key, or without rows, is an ordinary join; columns of both sides
    with one name, but for the key, get the suffix ``_dim`` on the right (and
    an underscore more while that is taken too).
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    own = {c.lower() for c in facts.columns}
    for c in dims.columns:
        if c != key and c.lower() in own:
            dims = dims.withColumnRenamed(c, fresh(f"{c}_dim", facts, dims))
    heavy = heavy_keys(facts, key, share)[0] if heavy is None else heavy
    found = heavy.select(key, *[c for c in heavy.columns if c == "n_rows"]).collect()
    few = facts.sparkSession.createDataFrame([(r[0],) for r in found], heavy.select(key).schema)
    of_heavy = dims.join(F.broadcast(few), key, "left_semi")
    light = lambda x: x.join(dims.hint("merge"), key, how)
    if of_heavy.limit(dim_rows + 1).count() <= dim_rows:
        return split_apply(facts, key, few, lambda x: x.join(F.broadcast(of_heavy), key, how), light)
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = [(r[0], max(2, -(-r["n_rows"] // salted_rows)) if "n_rows" in heavy.columns else partitions) for r in found]
    number, salt = fresh("_salts", facts, dims), fresh("_salt", facts, dims)
    spread = F.broadcast(facts.sparkSession.createDataFrame(salts, f"`{key}` {facts.schema[key].dataType.simpleString()}, {number} int"))
    plain = [F.col(f"`{f.name}`") for f in facts.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]

    def salted(x: DataFrame) -> DataFrame:
        some = x.join(spread, key).withColumn(salt, F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.col(number)).cast("int")).drop(number)
        copies = of_heavy.join(spread, key).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(number) - 1))).drop(number)
        return some.join(copies.hint("merge"), [key, salt], how).drop(salt)

    return split_apply(facts, key, few, salted, light)
