import random
import statistics

import pytest

from siftbase.operators.blocks import nonvariant_blocks

SCHEMA = "sample_id long, pos int, dp int, rr int, vr int, called boolean"


def literal(rows):
    """rows: (pos, dp, rr, vr, called) of one key; the rule position by position."""
    rows = sorted(rows)
    out, at = [], {r[0]: r for r in rows}
    for p, *_, called in rows:
        if called or (p - 1 in at and not at[p - 1][4]):
            continue
        end = p
        while end + 1 in at and not at[end + 1][4]:
            end += 1
        blocked = end + 1 in at
        block, start = [], p
        for i in range(p, end + 2 if blocked else end + 1):
            v = at[i][1:4]
            reason = None
            if not blocked and i == end:
                reason = "endofregion"
            elif blocked and i == end + 1:
                reason = "blocked"
            elif block:
                dps = [b[0] for b in block]
                if v[0] == 0 and min(dps) > 0:
                    reason = "cov2nocov"
                elif max(dps) == 0 and v[0] > 0:
                    reason = "nocov2cov"
                else:
                    for k, name in enumerate(("dp", "rr", "vr")):
                        xs = [b[k] for b in block] + [v[k]]
                        if max(xs) - min(xs) > max(0.3 * min(xs), 3):
                            reason = name
                            break
            if reason:
                stats = []
                for k in range(3):
                    c = [b[k] for b in block]
                    stats += [min(c), max(c), sum(c) / len(c), statistics.stdev(c) if len(c) > 1 else 0.0] if c else [0, 0, 0.0, 0.0]
                out.append((start, i if reason == "endofregion" else i - 1, reason, len(block), *[round(x, 6) for x in stats]))
                block, start = [], i
            block.append(v)
    return sorted(out)


def rounded(rows):
    return sorted((*r[1:5], *[round(float(x), 6) for x in r[5:]]) for r in map(tuple, rows))


def test_worked_example(spark):
    values = [0, 0, 5, 6, 9, 8, 20, 21, 0]
    df = spark.createDataFrame([(1, i, v, v, 0, False) for i, v in enumerate(values)], SCHEMA)
    got = sorted((r["block_first"] + 1, r["block_last"] + 1, r["reason"], r["dp_min"], r["dp_max"], r["dp_mean"], r["n_stats"]) for r in nonvariant_blocks(df, ["sample_id"]).collect())
    assert got == [(1, 2, "nocov2cov", 0, 0, 0.0, 2), (3, 4, "dp", 5, 6, 5.5, 2), (5, 6, "dp", 8, 9, 8.5, 2), (7, 9, "endofregion", 20, 21, 20.5, 2)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_literal_rule(spark, seed, monkeypatch):
    monkeypatch.setattr("siftbase.operators.blocks.WIDTH", 16)
    rng = random.Random(seed)
    data, want = [], []
    for s in range(6):
        rows, dp = [], 10
        for p in range(200):
            dp = max(0, dp + rng.choice([0, 0, 1, -1, 3, -3])) if rng.random() > 0.05 else rng.choice([0, 5, 30])
            if rng.random() > 0.04:
                rows.append((p, dp, max(0, dp - rng.randrange(3)), rng.randrange(3), rng.random() < 0.05))
        want += [(s, *b) for b in literal(rows)]
        data += [(s, *r) for r in rows]
    rng.shuffle(data)
    got = nonvariant_blocks(spark.createDataFrame(data, SCHEMA).repartition(3), ["sample_id"]).collect()
    assert sorted((r[0], *r[1:5], *[round(float(x), 6) for x in r[5:]]) for r in map(tuple, got)) == sorted(want)


def test_empty_and_nulls(spark):
    assert nonvariant_blocks(spark.createDataFrame([], SCHEMA), ["sample_id"]).count() == 0
    df = spark.createDataFrame([(None, 1, 5, 5, 0, None), (None, 2, 5, 5, 0, None), (1, None, 5, 5, 0, False), (1, 3, None, 5, 0, False), (1, 9, 7, 7, 0, False)], SCHEMA)
    assert rounded(nonvariant_blocks(df, ["sample_id"]).select("sample_id", "block_first", "block_last", "reason", "n_stats").collect()) == [(1, 2, "endofregion", 1), (9, 9, "endofregion", 0)]


def test_long_stretches_of_equal_depth(spark):
    """Thirty million positions as one stretch, and some hundred thousand as rows: one block each."""
    df = spark.createDataFrame([(1, 0, 29_999_999, 0, 0, 0, False), (1, 30_000_000, 30_000_009, 50, 50, 0, False), (1, 30_000_010, 30_000_010, 9, 9, 9, True)], "sample_id long, first int, last int, dp int, rr int, vr int, called boolean")
    got = nonvariant_blocks(df, ["sample_id"], "first", last="last").collect()
    assert sorted((r["block_first"], r["block_last"], r["reason"], r["n_stats"]) for r in got) == [(0, 29_999_999, "nocov2cov", 30_000_000), (30_000_000, 30_000_009, "blocked", 10)]
    rows = spark.range(300_000).selectExpr("1L as sample_id", "cast(id as int) as pos", "0 as dp", "0 as rr", "0 as vr", "false as called")
    assert [tuple(r)[1:5] for r in nonvariant_blocks(rows, ["sample_id"]).collect()] == [(0, 299_999, "endofregion", 299_999)]


def test_stretches_equal_positions(spark, monkeypatch):
    monkeypatch.setattr("siftbase.operators.blocks.WIDTH", 16)
    rng = random.Random(9)
    stretches, at = [], 0
    for _ in range(150):
        at += rng.choice([0, 0, 0, 0, 3])
        n = rng.randrange(1, 25)
        dp = rng.choice([0, 5, 7, 9, 10, 12, 40])
        stretches.append((1, at, at + n - 1, dp, dp, 0, rng.random() / 2 if rng.random() < 0.5 else None, n == 1 and rng.random() < 0.5))
        at += n
    df = spark.createDataFrame(stretches, "sample_id long, first int, last int, dp int, rr int, vr int, p double, called boolean").repartition(3)
    bases = df.selectExpr("sample_id", "explode(sequence(first, last)) as pos", "dp", "rr", "vr", "p", "called")
    got = [sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in b.collect()) for b in (nonvariant_blocks(df, ["sample_id"], "first", last="last", p="p"), nonvariant_blocks(bases, ["sample_id"], p="p"))]
    assert got[0] == got[1] and len(got[0]) > 30
