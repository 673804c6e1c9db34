import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftbase.operators.carry import neighbours, running, with_bin
from siftbase.operators.coverage import coverage_at, coverage_runs
from siftbase.operators.intervals import merge_intervals, previous_gap
from siftbase.operators.joins import overlap_join, point_in_interval, with_known, with_targets
from siftbase.operators.skew import heavy_keys, skew_join, skew_totals


def brute_merge(rows):
    out = []
    for key in {r[0] for r in rows}:
        covered = set()
        for k, a, z in rows:
            if k == key and a is not None and z is not None and a <= z:
                covered |= set(range(a, z + 1))
        if not covered:
            continue
        xs = sorted(covered)
        runs = [[xs[0], xs[0]]]
        for x in xs[1:]:
            if x == runs[-1][1] + 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        out += [(key, "merged", a, z) for a, z in runs] + [(key, "gap", p[1] + 1, q[0] - 1) for p, q in zip(runs, runs[1:])]
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [3, 50, 1 << 15])
def test_merge_equals_sets_of_positions(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(400), s + rng.choice([0, 1, 3, 10, 60, -2])) for _ in range(60)] + [("a", None, 4), ("a", 4, None), ("c", 9, 3), ("a", 5, 500)]
    rows += rows[:10]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, first int, second int, kind string").repartition(4)
    got = sorted((tuple(r) for r in merge_intervals(df, ["k"], "first", "second", bin_width=width).collect()), key=str)
    assert got == brute_merge(rows)
    assert merge_intervals(df.limit(0), ["k"], "first", "second").count() == 0


def test_previous_gap(spark):
    df = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1), ("c", None), (None, 40), (None, 60)], "k string, pos int")
    got = {(r["k"], r["pos"]): (r["gap_first"], r["gap_second"]) for r in previous_gap(df, ["k"], "pos", width=16).collect()}
    assert got["c", None] == (None, None) and got[None, 60] == (41, 59)
    df = df.where("k in ('a', 'b')")
    assert sorted((r["k"], r["pos"], r["gap_first"], r["gap_second"]) for r in previous_gap(df, ["k"], "pos").collect()) == [("a", 5, None, 4), ("a", 9, 6, 8), ("b", 1, None, 0)]


def test_bounds_keep_their_type(spark):
    at = lambda x: datetime.datetime(2024, 1, 1, 0, 0, x // 100, x % 100 * 10_000)
    rows = [("a", 25, 75), ("a", 80, 90), ("a", 40, 60), ("b", 80, 90), ("b", 91, 95)]
    micro = datetime.timedelta(microseconds=1)
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(k, at(s), at(e)) for k, s, e in rows], f"k string, s {kind}, e {kind}")
        got = merge_intervals(df, ["k"], "s", "e")
        assert got.schema["s"].dataType.simpleString() == kind
        assert sorted(map(tuple, got.where("k = 'a'").collect())) == [("a", "gap", at(75) + micro, at(80) - micro), ("a", "merged", at(25), at(75)), ("a", "merged", at(80), at(90))]
    df = spark.createDataFrame([("a", 0.5, 0.6), ("a", 0.8, 0.9), ("a", 0.9, 1.5), ("a", float("nan"), 2.0), ("a", 7.0, float("inf")), ("a", float("-inf"), -3.0), ("b", 2.0, 1.0)], "k string, s double, e double")
    assert sorted(tuple(r)[1:] for r in merge_intervals(df, ["k"], "s", "e").collect() if r["kind"] == "merged") == [("merged", float("-inf"), -3.0), ("merged", 0.5, 0.6), ("merged", 0.8, 1.5), ("merged", 7.0, float("inf"))]
    assert ("a", "gap", 0.6, 0.8) in map(tuple, merge_intervals(df, ["k"], "s", "e").collect())
    df = df.where("s between 0 and 1").select("k", F.col("s").cast("decimal(9,3)").alias("s"), F.col("e").cast("decimal(9,3)").alias("e"))
    assert sorted((str(r["s"]), str(r["e"])) for r in merge_intervals(df, ["k"], "s", "e").where("kind = 'merged'").collect()) == [("0.500", "0.600"), ("0.800", "1.500")]
    days = spark.createDataFrame([(datetime.date(2024, 1, 1), datetime.date(2024, 1, 3)), (datetime.date(2024, 1, 4), datetime.date(2024, 1, 5)), (datetime.date(2024, 1, 9), datetime.date(2024, 1, 9))], "s date, e date")
    assert sorted((r["kind"], r["s"].day, r["e"].day) for r in merge_intervals(days, [], "s", "e").collect()) == [("gap", 6, 8), ("merged", 1, 5), ("merged", 9, 9)]
    big = spark.range(20_000).select(F.lit("a").alias("k"), (F.col("id") * 10**12).alias("s"), (F.col("id") * 10**12 + 5).alias("e"))
    assert merge_intervals(big, ["k"], "s", "e").groupBy("kind").count().collect() and merge_intervals(big, ["k"], "s", "e").count() == 39_999


def test_running_over_bins(spark):
    rng = random.Random(1)
    rows = [("a", p, rng.randrange(100) if rng.random() > 0.2 else None) for p in rng.sample(range(300), 100)] + [(None, 4, 7), (None, 250, None)]
    df = with_bin(spark.createDataFrame(rows, "k string, pos int, v int"), "pos", 16)
    for how, f in (("max", max), ("min", min), ("sum", sum)):
        got = {(r["k"], r["pos"]): r["o"] for r in running(df, ["k"], [F.col("pos")], F.col("v"), "o", how).collect()}
        for k, p, _ in rows:
            before = [v for a, b, v in rows if a == k and b <= p and v is not None]
            assert got[k, p] == (f(before) if before else (0 if how == "sum" else None))
    n = {r["pos"]: (r["_prev"] and r["_prev"]["pos"], r["_next"] and r["_next"]["pos"]) for r in neighbours(df.drop("_bin").where("k = 'a'"), ["k"], "pos", ["v"], 16).collect()}
    order = sorted(n)
    assert all(n[p] == (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, p in enumerate(order))


def test_heavy_keys_and_join(spark):
    rows = [("hot", i) for i in range(400)] + [(f"k{i % 90}", i) for i in range(500)] + [(None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "contig string, ord int").repartition(5)
    heavy, total = heavy_keys(df, "contig", 1 / 25)
    assert total == 1000 and [tuple(r) for r in heavy.collect()] == [("hot", 400)]
    dims = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("absent", 4)], "contig string, ord int")
    for how in ("inner", "left"):
        got = Counter((r["contig"], r["ord"], r["ord_dim"]) for r in skew_join(df, dims, "contig", 0.04, how).collect())
        d = {"hot": 1, "k1": 2, "k2": 3}
        assert got == Counter((c, o, d.get(c)) for c, o in rows if how == "left" or c in d)
    clash = df.withColumns({"_heavy_key": F.lit(1), "ord_dim": F.lit("x")})
    assert skew_join(clash, dims, "contig", 0.04, "left").columns == ["contig", "ord", "_heavy_key", "ord_dim", "ord_dim_"]
    for how in ("inner", "left"):  # a dimension too large to be sent: heavy keys are salted
        got = Counter((r["contig"], r["ord"], r["ord_dim"]) for r in skew_join(df, dims, "contig", 0.04, how, dim_rows=0, salted_rows=100).collect())
        assert got == Counter((c, o, d.get(c)) for c, o in rows if how == "left" or c in d)
    totals, n = skew_totals(df, "contig", 0.04, [F.count(F.lit(1)).alias("n"), F.max("ord").alias("top")], ["ord"])
    assert n == 1000 and {r["contig"]: (r["n"], r["top"]) for r in totals.collect()} == {k: (sum(c == k for c, _ in rows), max((o for c, o in rows if c == k and o is not None), default=None)) for k in {c for c, _ in rows}}
    empty, n = heavy_keys(df.limit(0), "contig", 0.5)
    assert n == 0 and empty.count() == 0 and skew_join(df.limit(0), dims, "contig").count() == 0
    with pytest.raises(ValueError):
        heavy_keys(df, "contig", 0)


def test_coverage(spark, monkeypatch):
    monkeypatch.setattr("siftbase.operators.coverage.BIN", 16)
    rng = random.Random(2)
    rows = [(rng.choice("ab"), s := rng.randrange(200), s + rng.randrange(30), rng.randrange(1, 4)) for _ in range(80)] + [("a", 5, 3, 1)]
    depth = Counter()
    for k, s, e, w in rows:
        for p in range(s, e + 1):
            depth[k, p] += w
    df = spark.createDataFrame(rows, "k string, first int, last int, w int")
    runs = coverage_runs(df, ["k"], ["w"], cap=None).collect()
    assert Counter({(r["k"], p): r["w"] for r in runs for p in range(r["first"], r["last"] + 1)}) == depth
    assert max(r["w"] for r in coverage_runs(df, ["k"], ["w"], cap=5).collect()) == 5
    points = spark.createDataFrame([("a", p) for p in range(240)] + [("z", 3), ("a", 3)], "k string, pos int")
    got = {(r["k"], r["pos"]): r["w"] for r in coverage_at(df, points, ["k"], ["w"], cap=None).collect()}
    assert got == {("a", p): depth["a", p] for p in range(240)} | {("z", 3): 0}


def test_interval_joins(spark):
    rng = random.Random(3)
    lhs = [(i, rng.choice("ab"), s := rng.randrange(300), s + rng.randrange(-1, 60)) for i in range(50)]
    rhs = [(i, rng.choice("ab"), s := rng.randrange(300), s + rng.randrange(60)) for i in range(50)]
    a = spark.createDataFrame(lhs, "i int, contig string, a int, z int")
    b = spark.createDataFrame(rhs, "j int, contig string, b int, y int")
    got = sorted((r["i"], r["j"]) for r in overlap_join(a, b, ["contig"], ("a", "z"), ("b", "y"), 16).collect())
    assert got == sorted((i, j) for i, c, s, e in lhs for j, d, t, f in rhs if s <= e and c == d and s <= f and t <= e)
    points = spark.createDataFrame([(c, p) for c in "abz" for p in range(0, 370, 3)], "contig string, pos int")
    hit = point_in_interval(points, b, ["contig"], "pos", "b", "y", width=16).collect()
    assert len(hit) == 3 * 124
    assert all(r["on_target"] == any(d == r["contig"] and t <= r["pos"] <= f for _, d, t, f in rhs) for r in hit)
    contigs = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "contig string, ord int")
    targets = spark.createDataFrame([("a", 1, 5), ("a", 7, 8), ("b", 9, 2), (None, 1, 2)], "contig string, coord_first int, coord_second int")
    assert [tuple(r) for r in with_targets(contigs, targets).collect()] == [("a", 0)]


def test_known(spark):
    calls = spark.createDataFrame([("a", 5, "ACG", "A"), ("a", 5, "A", "ATT"), ("b", 1, "AC", "A")], "contig string, pos int, ref string, alt string")
    known = spark.createDataFrame([("a", 5, "5D2", 0.1), ("a", 5, "5D2", 0.1), ("a", 5, "5IT", 0.3)], "contig string, pos int, key string, af double")
    assert sorted((r["contig"], r["alt"], r["af"]) for r in with_known(calls, known).collect()) == [("a", "A", 0.1), ("a", "ATT", None), ("b", "A", None)]
