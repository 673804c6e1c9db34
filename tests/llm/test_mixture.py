import math
from collections import Counter

import numpy as np
import pytest

from siftbase.llm import mixture
from siftbase.llm.bpe import VOCABULARY, encoder
from siftbase.llm.mixture import mix_sources


@pytest.mark.parametrize("shards, levels", [(9, 8), (41, 2), (1, 8), (700, 3)])
def test_splitting_tree_is_exact(spark, monkeypatch, shards, levels):
    monkeypatch.setattr(mixture, "LEVELS", levels)
    blocks = {"a": 1000, "b": 7, "c": 1, "d": 5000, "e": 0}
    counts = spark.createDataFrame([*blocks.items()], "source string, n_blocks long").repartition(2)
    rows = mixture.shard_ranges(counts, shards, 5).collect()
    taken = {}
    for r in rows:
        taken.setdefault(r["source"], []).append((r["start"], r["start"] + r["have"]))
    for k, n in blocks.items():  # ranges of a source are disjoint and whole
        ranges = sorted(taken.get(k, []))
        assert [a for a, _ in ranges] == [0, *[z for _, z in ranges][:-1]] if n else not ranges
        assert not n or ranges[-1][1] == n
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["have"]
    assert len(held) == shards and max(held.values()) - min(held.values()) <= 1 + math.log2(shards)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixture.shard_ranges(counts.repartition(3), shards, 5).collect()))


def test_draws_are_hypergeometric():
    left = [next(p for f, n, s, p, b in mixture.split_node(0, 2, np.array([30, 10]), np.zeros(2, np.int64), 1, seed) if f == 0) for seed in range(3000)]
    ones = np.array([x[0] for x in left])
    assert abs(ones.mean() - 15) < 0.2 and abs(ones.var() - 20 * 0.75 * 0.25 * 20 / 39) < 0.25


@pytest.fixture
def corpus(spark):
    data = [(i, f"some words {i} " * (1 + i % 7), s, "x") for s, n in (("big", 400), ("mid", 90), ("small", 12), ("other", 50)) for i in range(n)]
    data = [(k, t, s, x) for k, (_, t, s, x) in enumerate(data)]
    data += [(9001, None, "big", None), (9002, "", "mid", None), (9003, "no source", None, None), (None, "null id", "mid", None), (3, "same id", "mid", None)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, repeat string").repartition(3), data


def test_shares_repeats_and_blocks(spark, corpus):
    docs, data = corpus
    plan = spark.createDataFrame([("big", 5.0, 1), ("mid", 3.0, 4), ("small", 2.0, 3), ("absent", 1.0, 2), ("zero", None, None)], "source string, weight double, max_repeats int")
    m = mix_sources(docs, plan, block_tokens=40, shard_tokens=700)
    enc = encoder(VOCABULARY)
    size = Counter()
    for _, t, s, _ in data:
        size[s] += len(enc.encode([t])[0])
    total = size["big"] + size["mid"] + size["small"]
    shares = {r["source"]: r for r in m.shares.collect()}
    for s, w, most in (("big", 5, 1), ("mid", 3, 4), ("small", 2, 3), ("absent", 1, 2)):
        target = w / 11 * total
        assert shares[s]["short"] == (most * size[s] < target)
        want = min(target, most * size[s])
        assert want - 30 < shares[s]["taken_tokens"] <= want
    rows = m.rows.collect()
    assert Counter(r["source"] for r in rows).keys() <= {"big", "mid", "small"}
    for s in ("big", "mid", "small"):
        assert sum(r["n_tokens"] for r in rows if r["source"] == s) == shares[s]["taken_tokens"]
    times = Counter((r["source"], r["doc_id"], r["repeat"]) for r in rows if r["doc_id"] not in (3, None))
    assert max(times.values()) == 1
    assert all(r["repeat"] < {"big": 1, "mid": 4, "small": 3}[r["source"]] for r in rows)
    assert abs(sum(r["reached_share"] for r in shares.values()) - 1) < 1e-9
    shards = Counter(r["shard"] for r in rows)
    assert len(shards) > 3
    assert sorted((r["shard"], r["position"]) for r in rows) == [(s, p) for s in sorted(shards) for p in range(shards[s])]


def test_a_plan_too_large_to_be_sent(spark, corpus, monkeypatch):
    docs, _ = corpus
    plan = spark.createDataFrame([("big", 5.0, 1), ("mid", 3.0, 4), ("small", 2.0, 3)], "source string, weight double, max_repeats int")
    want = sorted(map(tuple, mix_sources(docs, plan, block_tokens=40, shard_tokens=700).shares.collect()))
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixture, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, mix_sources(docs, plan, block_tokens=40, shard_tokens=700).shares.collect())) == want


def test_empty(spark, corpus):
    docs, _ = corpus
    plan = spark.createDataFrame([("big", 1.0, 1)], "source string, weight double, max_repeats int")
    m = mix_sources(docs.limit(0), plan)
    assert m.rows.count() == 0 and [r["short"] for r in m.shares.collect()] == [False]
    m = mix_sources(docs, plan.limit(0))
    assert m.rows.count() == 0 and m.shares.count() == 0
