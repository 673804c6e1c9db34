import random
import time

import numpy as np
import pytest

from siftbase.llm.split import balanced_pieces, letter_stretches, split_items


def check(pieces, first, second, limit, overlap):
    assert pieces[0][0] == first and pieces[-1][1] == second
    assert all(0 < e - s + 1 <= limit for s, e, _ in pieces)
    assert all(b[0] == a[1] - overlap + 1 and b[0] > a[0] and b[1] > a[1] for a, b in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("seed", range(40))
def test_pieces_cover_and_keep_the_limit(seed):
    rng = random.Random(seed)
    for _ in range(50):
        limit = rng.randrange(1, 120)
        overlap = rng.randrange(0, limit)
        first = rng.randrange(50)
        second = first + limit + rng.randrange(1000)
        a = sorted(rng.sample(range(first, second - 10), k=min(rng.randrange(6), second - 10 - first))) if second - 10 > first else []
        a = [x for i, x in enumerate(a) if i == 0 or x > a[i - 1] + 12]
        z = [min(x + rng.randrange(9, 11), second) for x in a]
        check(balanced_pieces(first, second, limit, overlap, np.array(a, np.int64), np.array(z, np.int64)), first, second, limit, overlap)


def test_snaps_to_the_strongest():
    pieces = balanced_pieces(0, 1999, 1200, 100, np.array([900, 1000, 1500]), np.array([909, 1049, 1509]))
    assert pieces == [(0, 1074, -1), (975, 1999, 1000)]
    # a snap that breaks the limit adds a piece
    assert [p[2] for p in balanced_pieces(0, 1999, 1010, 0, np.array([700]), np.array([720]))] == [-1, 700, -1]
    # only there: all other snaps stay
    rng = random.Random(7)
    a = np.array(sorted(rng.sample(range(0, 999_000, 25), 4000)), np.int64)
    began = time.time()
    pieces = balanced_pieces(0, 999_999, 1000, 0, a, a + 15)
    assert time.time() - began < 2 and 1000 <= len(pieces) < 1700 and sum(p[2] < 0 for p in pieces) < 150
    check(pieces, 0, 999_999, 1000, 0)


def test_stretches_cross_tiles(spark):
    rows = [("a", 0, "ACGTNNNNNN"), ("a", 10, "nnnnnnnnnn"), ("a", 20, "NACNNNNNNN"), ("a", 30, "ACNNNNNNNNNNNN"), ("a", 20, "NACNNNNNNN"), ("b", 0, None), ("b", 5, ""), (None, 0, "NNNNNNNNNNNNN")]
    got = letter_stretches(spark.createDataFrame(rows, "contig string, tile_start int, seq string").repartition(3))
    assert sorted(map(tuple, got.collect())) == [("a", 4, 20), ("a", 32, 43)]


def test_table(spark):
    schema = "target_id long, contig string, a int, z int, most int, share int, first string"
    rows = [(1, "a", 0, 99, 40, 5, "x"), (1, "a", 0, 99, 40, 5, None), (2, "a", 0, 39, 40, 5, "x"), (3, None, 0, 99, 40, 5, "x"), (4, "a", 9, 3, 40, 5, "x"), (5, "a", 0, 99, None, 5, "x"), (None, "c", 0, 99, 40, None, "x"), (6, "a", 30, 99, 40, 90, "x")]
    bounds = spark.createDataFrame([("a", 20, 34), ("a", 95, 104)], "contig string, first long, last long")
    args = ("target_id", "contig", "a", "z", "most", "share")
    got = {r["target_id"]: r for r in split_items(spark.createDataFrame(rows, schema), bounds, *args, bin_width=16).collect()}
    assert set(got) == {1, None, 6}
    assert [b["first"] for b in got[1]["boundaries"]] == [20] and got[None]["boundaries"] == [] and got[6]["boundaries"] == []
    for k, o in ((1, 5), (None, 0), (6, 39)):
        check([tuple(p)[:3] for p in got[k]["pieces"]], 30 if k == 6 else 0, 99, 40, o)
    assert sorted(f for p in got[1]["pieces"] for f in p["stretches"]) == [20]
    assert split_items(spark.createDataFrame([], schema), bounds, *args).count() == 0
