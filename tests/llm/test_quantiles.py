import math
import random

import pytest
from pyspark.sql import functions as F

from siftbase.llm import quantiles
from siftbase.llm.quantiles import above_median, combine, multi_select, summarise


def nearest_rank(xs, q):
    xs = sorted(xs)
    return xs[max(1, math.ceil(q * len(xs))) - 1]


@pytest.mark.parametrize("state_bound", [100_000, 0])
def test_equals_sorting(spark, monkeypatch, state_bound):
    monkeypatch.setattr(quantiles, "BROADCAST_STATE", state_bound)
    monkeypatch.setattr(quantiles, "ROW_VALUES", 7)
    rng = random.Random(3)
    data = []
    for g in ["a", "b", None, "one", "tie"]:
        n = {"one": 1, "a": 900}.get(g, 200)
        data += [(g, rng.randrange(6), 4.0 if g == "tie" else rng.choice([rng.gauss(0, 50), float(rng.randrange(5))])) for _ in range(n)]
    df = spark.createDataFrame([*data, ("a", 1, None), ("none", 2, None), ("a", None, float("nan"))], "g string, day int, x double")
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    days = [summarise(df.where(f"day % 2 = {k}"), "g", "x", "day") for k in (0, 1)]
    got = {(r["g"], r["quantile"]): r["value"] for r in multi_select(combine(*days), "g", qs).collect()}
    groups = {g for g, _, _ in data}
    assert got == {(g, q): nearest_rank([x for k, _, x in data if k == g], q) for g in groups for q in qs}


def test_bounded_error_and_size(spark):
    rng = random.Random(4)
    xs = [rng.lognormvariate(3, 2) for _ in range(3000)]
    df = spark.createDataFrame([("g", i % 3, x) for i, x in enumerate(xs)], "g string, day int, x double")
    s = summarise(df, "g", "x", "day", relative_error=0.01)
    assert s.selectExpr("max(size(values))").first()[0] < 900
    for r in multi_select(s, "g", [0.05, 0.5, 0.99]).collect():
        assert abs(r["value"] / nearest_rank(xs, r["quantile"]) - 1) < 0.011


def test_empty_and_outliers(spark):
    empty = spark.createDataFrame([], "g string, day int, x int")
    assert multi_select(summarise(empty, "g", "x", "day"), "g", [0.5]).count() == 0
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 2, 21), ("a", 2, 20), (None, 1, 5)], "g string, day int, x int")
    med = multi_select(summarise(df, "g", "x", "day"), "g", [0.5])
    assert above_median(df.withColumns({"_median": F.lit(1), "_mg": F.lit(2), "n": F.lit(3)}), med, "g", "x", 10.0).columns == ["g", "day", "x", "_median", "_mg", "n"]
    assert [r["x"] for r in above_median(df, med, "g", "x", 10.0).collect()] == [21]


def test_infinities(spark):
    inf = float("inf")
    xs = {"a": [-inf] * 6 + [1.0, 2.0], "b": [inf, inf, -inf, 3.0], "c": [1.7976931348623157e308, inf, inf, -inf], "d": [inf]}
    df = spark.createDataFrame([(g, i % 2, x) for g, v in xs.items() for i, x in enumerate(v)], "g string, day int, x double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for error in (None, 0.01):
        got = {(r["g"], r["quantile"]): r["value"] for r in multi_select(summarise(df.where("x <> 1.7976931348623157e308") if error else df, "g", "x", "day", error), "g", qs).collect()}
        if not error:
            assert got == {(g, q): nearest_rank(v, q) for g, v in xs.items() for q in qs}
        assert got["a", 0.5] == -inf and got["d", 0.5] == inf


def test_a_part_too_large_for_a_task(spark):
    df = spark.range(6_000).select(F.lit("hot").alias("g"), F.lit(1).alias("day"), ((F.col("id") * 7919) % 6_000).cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        s = summarise(df, "g", "x", "day").cache()
        got = {r["quantile"]: r["value"] for r in multi_select(s, "g", [0.1, 0.5, 0.999]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert got == {0.1: 599.0, 0.5: 2999.0, 0.999: 5993.0}
