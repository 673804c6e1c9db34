import random

import numpy as np
import pytest

from siftbase.llm.runs import Tolerance, collapse_runs, optimum


def greedy(rows):
    """rows: (pos, id, dp, rr, vr) of one entity, in any order."""
    out, run, seen = [], None, set()
    for pos, i, *v in sorted(rows, key=lambda r: (r[0], r[1])):
        if (pos, i) in seen:
            continue
        seen.add((pos, i))
        if run:
            lo = [min(a, b) for a, b in zip(run["lo"], v)]
            hi = [max(a, b) for a, b in zip(run["hi"], v)]
            ok = pos == run["to"] + 1 and all(10 * (h - x) <= max(30, 3 * x) for x, h in zip(lo, hi)) and (v[0] == 0) == (run["lo"][0] == 0)
            if ok:
                run.update(lo=lo, hi=hi, to=pos)
                continue
            out.append((run["from"], run["to"]))
        run = {"from": pos, "to": pos, "lo": v, "hi": v}
    if run:
        out.append((run["from"], run["to"]))
    return sorted(out)


def series(rng, n):
    rows, pos, dp = [], rng.randrange(0, 40), rng.randrange(0, 30)
    for i in range(n):
        pos += 1 if rng.random() < 0.97 else rng.randrange(2, 30)
        dp = max(0, dp + rng.choice([0, 0, 0, 1, -1, 2, -2, 5, -5])) if rng.random() > 0.02 else 0
        rows.append((pos, i, dp, max(0, dp - rng.randrange(2)), rng.randrange(2)))
    return rows


@pytest.mark.parametrize("width", [4, 16, 64, 8192])
def test_equals_going_through_the_events(spark, width):
    rng = random.Random(width)
    data, want = [], []
    for e in range(30):
        rows = series(rng, rng.randrange(1, 200)) if e % 5 else [(p, p, 20, 20, 0) for p in range(0, 150 + e)]
        want += [(e, f"c{e % 3}", a, b) for a, b in greedy(rows)]
        rows = rows + rng.sample(rows, len(rows) // 10)
        data += [(e, f"c{e % 3}", *r) for r in rows]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "sample_id long, contig string, pos int, rec_id long, dp int, rr int, vr int").repartition(5)
    got = collapse_runs(df, ["sample_id", "contig"], "pos", ["dp", "rr", "vr"], "rec_id", zero_splits="dp", bin_width=width)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)


def test_fewest_runs_of_any_segmentation(spark):
    rng = random.Random(5)
    rows = series(rng, 120)
    v = [r[2:] for r in rows]

    def fits(i, j):
        ps = [r[0] for r in rows[i:j]]
        cols = list(zip(*v[i:j]))
        return ps == list(range(ps[0], ps[0] + len(ps))) and all(10 * (max(c) - min(c)) <= max(30, 3 * min(c)) for c in cols) and len({x == 0 for x in cols[0]}) == 1

    best = [0] + [10**9] * len(rows)
    for j in range(1, len(rows) + 1):
        best[j] = min(best[i] + 1 for i in range(j) if fits(i, j))
    df = spark.createDataFrame([(1, "c", *r) for r in rows], "sample_id long, contig string, pos int, rec_id long, dp int, rr int, vr int")
    got = collapse_runs(df, ["sample_id", "contig"], "pos", ["dp", "rr", "vr"], "rec_id", zero_splits="dp", bin_width=32)
    assert got.count() == best[-1]


def test_nulls_ties_and_empty(spark):
    schema = "sample_id long, contig string, pos int, rec_id long, dp int, rr int, vr int, starts string"
    data = [
        (None, None, 1, 1, 5, 5, 0, "x"), (None, None, 2, 2, 5, 5, 0, None), (1, "a", None, 3, 5, 5, 0, "x"), (1, "a", 3, 4, None, 5, 0, "x"),
        (1, "a", 8, 5, 5, 5, 0, "x"), (1, "a", 8, 6, 5, 5, 0, "x"), (1, "a", 9, None, 5, 5, 0, "x"),
    ]
    args = (["sample_id", "contig"], "pos", ["dp", "rr", "vr"], "rec_id")
    got = collapse_runs(spark.createDataFrame(data, schema), *args)
    assert sorted(tuple(r)[2:5] for r in got.collect()) == [(1, 2, 2), (8, 8, 1), (8, 9, 2)]
    assert collapse_runs(spark.createDataFrame([], schema), *args).count() == 0


def full_program(v, forced, tol, penalty, weight):
    """All candidates, none pruned: least cost from each event on, and of equal ones the longest first run."""
    n = len(v)
    full, choice = np.zeros(n + 1), np.zeros(n, int)
    for i in range(n - 1, -1, -1):
        costs = {}
        for j in range(i + 1, n + 1):
            if forced[i + 1 : j].any() or not tol.holds(v[i:j].min(0), v[i:j].max(0)):
                continue
            costs[j] = penalty + weight * ((v[i:j] - v[i:j].mean(0)) ** 2).sum() + (0 if j == n or forced[j] else full[j])
        full[i] = min(costs.values())
        choice[i] = max(j for j, c in costs.items() if c <= full[i] + 1e-7)
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at = choice[at]
    return full[:n], starts


@pytest.mark.parametrize("weight", [0.0, 0.05, 0.7, 20.0])
@pytest.mark.parametrize("seed", range(8))
def test_pruned_program_equals_the_full_one(seed, weight):
    rng = np.random.default_rng(seed)
    n, tol = 70, Tolerance(6)
    v = np.cumsum(rng.integers(-2, 3, (n, 2)), axis=0) + 25
    forced = rng.random(n) < 0.05
    marks, best = optimum(v, forced, tol, 2.5, weight)
    cost, starts = full_program(v, forced, tol, 2.5, weight)
    assert np.allclose(best, cost) and np.flatnonzero(marks).tolist() == starts


@pytest.mark.parametrize("width", [8, 8192])
def test_weighted_runs_of_a_table(spark, width):
    rng = random.Random(width)
    data, want = [], []
    for e in range(12):
        rows = series(rng, rng.randrange(1, 90))
        pos, v = np.array([r[0] for r in rows]), np.array([r[2:] for r in rows], float)
        forced = np.append(True, (pos[1:] != pos[:-1] + 1) | ((v[1:, 0] == 0) != (v[:-1, 0] == 0)))
        _, starts = full_program(v, forced, Tolerance(), 3.0, 0.4)
        want += [(e, int(pos[a]), int(pos[z - 1]), z - a) for a, z in zip(starts, [*starts[1:], len(pos)])]
        data += [(e, *r) for r in rows + rows[:3]]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "sample_id long, pos int, rec_id long, dp int, rr int, vr int").repartition(3)
    got = collapse_runs(df, ["sample_id"], "pos", ["dp", "rr", "vr"], "rec_id", zero_splits="dp", bin_width=width, penalty=3.0, weight=0.4)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert collapse_runs(df.limit(0), ["sample_id"], "pos", ["dp", "rr", "vr"], "rec_id", weight=0.4).count() == 0


@pytest.mark.parametrize("weight", [0.0, 0.4])
def test_ties_at_the_edges_of_a_bin(spark, weight):
    """Two events at the last and at the first position of a bin: each begins a run, and one goes on."""
    rows = [(1, 5, 1, 9), (1, 6, 2, 9), (1, 7, 3, 9), (1, 7, 4, 9), (1, 8, 5, 9), (1, 8, 6, 9), (1, 9, 7, 9), (2, 7, 1, 9), (2, 8, 2, 9), (2, 8, 3, 9), (2, 15, 4, 9), (2, 15, None, 9), (2, 16, 5, 9)]
    df = spark.createDataFrame(rows, "sample_id long, pos int, rec_id long, dp int")
    got = collapse_runs(df, ["sample_id"], "pos", ["dp"], "rec_id", bin_width=8, weight=weight)
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, 5, 7, 3), (1, 7, 8, 2), (1, 8, 9, 2), (2, 7, 8, 2), (2, 8, 8, 1), (2, 15, 15, 1), (2, 15, 16, 2)]
