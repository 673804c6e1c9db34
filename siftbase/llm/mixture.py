"""Problem 7: one mixture of several sources with target shares of the tokens.

Each source gets a quota of tokens, its share of the total, bounded by what its
permitted repeats hold. A repeat of a source is cut into blocks by a hash of the
document, so that a block is a random part of the source and no source is ever
sorted. The blocks taken are dealt to output shards by a multivariate-
hypergeometric splitting tree: a node holds the exact number of blocks of each
source, and draws how many of them its left half gets, down to single shards;
so each shard has a random mixture and the totals stay exact. A node is a row
per source; a task takes whole nodes some levels down, each with its own seed,
and passes the nodes that it reached on by shuffle. Shards then take disjoint
ranges of their sources' permuted blocks and are shuffled on their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftbase.llm.bpe import VOCABULARY, encode_corpus
from siftbase.operators.carry import running
from siftbase.session import cut

#: Sources of a plan up to which its rows are sent to the documents; a larger plan meets them by shuffle.
BROADCAST_SOURCES = 100_000
#: Blocks up to which their shards are broadcast to the documents.
BROADCAST_BLOCKS = 200_000
#: Levels of the splitting tree that a task goes down before its nodes are shuffled.
LEVELS = 8
#: Blocks that one draw may be about; beyond it (with the default size of blocks over 10^13 tokens) blocks grow.
MOST_DRAWN = 500_000_000
NODE = "first bigint, n bigint, source string, have bigint, start bigint"


@dataclass
class Mixture:
    """``rows``: shard, position, doc, source, repeat, n_tokens. ``shares``: what each source should give and gives."""

    rows: DataFrame
    shares: DataFrame


def split_node(first: int, n: int, have: np.ndarray, start: np.ndarray, levels: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first shard, shards, sources, blocks of each, first of these) of the nodes ``levels`` below a node, or of single shards.

    A node keeps only the sources it has blocks of.
    """
    rng = np.random.default_rng([seed, first, n])
    kept = np.flatnonzero(have)
    todo = [(first, n, kept, have[kept], start[kept], levels)]
    while todo:
        first, n, source, have, start, down = todo.pop()
        if not len(source):
            continue
        if n == 1 or not down:
            yield first, n, source, have, start
            continue
        half = n // 2
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * half // n, method="marginals")
        for at, k, part, begin in ((first, half, left, start), (first + half, n - half, have - left, start + left)):
            some = part > 0
            todo.append((at, k, source[some], part[some], begin[some], down - 1))


def _descend(levels: int, seed: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole nodes: rows lie in order of ``first``."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            at = np.append(0, np.flatnonzero(np.diff(b.column(0).to_numpy())) + 1)
            if held and held[0].column(0)[0] != b.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            for s, e in zip(at, np.append(at[1:], b.num_rows), strict=True):
                if held and s:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in nodes(batches):
            t = t.combine_chunks()
            names = t.column("source").chunk(0)
            have, start = (t.column(c).to_numpy() for c in ("have", "start"))
            for first, n, source, part, begin in split_node(t.column("first")[0].as_py(), t.column("n")[0].as_py(), have, start, levels, seed):
                k = len(source)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, first)), pa.array(np.full(k, n)), names.take(pa.array(source)), pa.array(part), pa.array(begin)], names=["first", "n", "source", "have", "start"]
                )

    return run


def shard_ranges(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source``, ``shard``, ``start``, ``have``: the range of the permuted blocks of each source that each shard takes.

    ``counts`` has ``source`` and ``n_blocks``. The tree is deterministic: a node's
    draws depend on the seed, its place and its counts only.
    """
    nodes = counts.where("n_blocks > 0").select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("n"), "source", F.col("n_blocks").alias("have"), F.lit(0).cast("long").alias("start"))
    for _ in range(math.ceil(math.ceil(math.log2(max(1, shards))) / LEVELS)):
        nodes = nodes.repartition("first").sortWithinPartitions("first", "source").mapInArrow(_descend(LEVELS, seed), NODE)
    return nodes.select("source", F.col("first").alias("shard"), "start", "have")


def mix_sources(
    docs: DataFrame,
    plan: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    vocabulary: str = VOCABULARY,
    block_tokens: int = 1 << 16,
    shard_tokens: int = 1 << 22,
    seed: int = 17,
) -> Mixture:
    """Documents drawn so that each source of ``plan`` (source, weight, max_repeats) has its share of the tokens.

    The total is what the plan's sources hold, each text once. A source gives
    whole repeats, then blocks of one more repeat, and of the last block
    documents as long as they stay inside the quota; so it misses its quota by
    less than a document, unless ``max_repeats`` bounds it, which ``shares``
    reports as ``short``. ``shares`` has what the shards hold of each source.

    Defined cases: sources outside the plan and null sources are left out; a
    source of the plan without documents gives nothing; a null or negative
    weight is 0, a null max_repeats 1; texts without tokens go where their
    hash puts them; rows with one id are rows of their own; an empty corpus or
    plan gives no rows; further columns are left out.
    """
    plan = plan.select(F.col("source").cast("string").alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"),
                       F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).where("source is not null")
    near = F.broadcast if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else (lambda x: x)
    texts = docs.select(F.struct(F.col(id_col).alias("doc"), F.col(source_col).alias("source")).alias("key"), F.col(text_col).alias("text"))
    texts = texts.join(near(plan.select("source")), F.col("key.source") == F.col("source"), "left_semi")
    sized = encode_corpus(texts, "key", "text", vocabulary, counts_only=True)
    sized = cut(sized.select("key.doc", "key.source", "n_tokens"))

    quota = cut(plan.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long")))
    sums = quota.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weights")).first()
    total, weights = sums["total"], sums["weights"] or 1.0
    block = max(block_tokens, -(-total // MOST_DRAWN))
    quota = quota.withColumn("target_tokens", F.col("weight") / F.lit(weights) * F.lit(float(total))).withColumn("most", (F.col("max_repeats") * F.col("tokens")).cast("long"))
    quota = quota.withColumn("take", F.when(F.col("most") < F.col("target_tokens"), F.col("most")).otherwise(F.floor("target_tokens").cast("long")))
    quota = quota.withColumn("whole", F.coalesce(F.expr("try_divide(take - take % nullif(tokens, 0), tokens)").cast("int"), F.lit(0)))
    quota = quota.withColumn("rest", F.col("take") - F.col("whole") * F.col("tokens")).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block)).cast("long"))

    few = near(quota.select("source", "whole", "rest", "n_blocks"))
    drawn = sized.join(few, "source").where("whole > 0 or rest > 0")
    drawn = drawn.withColumn("repeat", F.explode(F.expr("sequence(0, whole - if(rest > 0, 0, 1))")))
    drawn = drawn.withColumn("_hash", F.xxhash64(F.lit(seed), "doc", "repeat"))
    drawn = drawn.withColumn("block", F.pmod("_hash", F.col("n_blocks")))

    # The last repeat: blocks in order while they fit, then documents of one block.
    last = drawn.where(F.col("repeat") == F.col("whole"))
    by_block = last.groupBy("source", "block").agg(F.sum("n_tokens").alias("of_block")).withColumn("_bin", F.shiftright("block", 14))
    by_block = running(by_block, ["source"], [F.col("block")], F.col("of_block"), "upto", "sum")
    edges = by_block.select(F.col("source").alias("_s"), F.col("block").alias("_b"), (F.col("upto") - F.col("of_block")).alias("_start"), F.col("upto").alias("_end"))
    placed = last.join(edges, (F.col("source") == F.col("_s")) & (F.col("block") == F.col("_b"))).where("_start < rest")
    inner = placed.where("_end <= rest").drop("_s", "_b", "_start", "_end")
    edge = placed.where("_end > rest").withColumn(
        "_sum", F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("_hash", "doc", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    edge = edge.where("_start + _sum <= rest").drop("_s", "_b", "_start", "_end", "_sum")
    taken = drawn.where(F.col("repeat") < F.col("whole")).unionByName(inner).unionByName(edge)
    taken = cut(taken.select("doc", "source", "repeat", "block", "n_tokens", "_hash"))

    # Blocks in a random order of their source: their place counts along bins of the order's hash.
    blocks = taken.groupBy("source", "repeat", "block").agg(F.sum("n_tokens").alias("of_block")).withColumn("_order", F.xxhash64(F.lit(seed + 1), "source", "repeat", "block"))
    blocks = running(blocks.withColumn("_bin", F.shiftright("_order", 52)), ["source"], [F.col("_order"), F.col("repeat"), F.col("block")], F.lit(1), "ordinal", "sum", inclusive=False)
    blocks = cut(blocks.select("source", "repeat", "block", "of_block", F.col("ordinal").cast("long").alias("ordinal")))
    sums = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("of_block"), F.lit(0)).alias("tokens")).first()
    n_shards = max(1, min(sums["n"], -(-sums["tokens"] // shard_tokens)))
    ranges = shard_ranges(blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks")), n_shards, seed)
    dealt = ranges.select("source", "shard", F.explode(F.sequence("start", F.col("start") + F.col("have") - 1)).alias("ordinal"))
    dealt = blocks.join(dealt, ["source", "ordinal"]).select("source", "repeat", "block", "shard")
    if sums["n"] <= BROADCAST_BLOCKS:
        dealt = F.broadcast(dealt)
    held = taken.join(dealt, ["source", "repeat", "block"])
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "_hash"), "doc", "repeat")
    mixed = held.withColumn("position", F.row_number().over(shuffled) - 1)
    mixed = mixed.select("shard", "position", F.col("doc").alias(id_col), F.col("source").alias(source_col), "repeat", "n_tokens")

    given = held.groupBy("source").agg(F.sum("n_tokens").alias("taken_tokens"))
    shares = quota.join(given, "source", "left").withColumn("taken_tokens", F.coalesce("taken_tokens", F.lit(0)).cast("long")).select(
        "source", "weight", "max_repeats", "tokens", "target_tokens", "taken_tokens",
        (F.col("weight") / F.lit(weights)).alias("target_share"),
        (F.col("taken_tokens") / F.lit(max(1, sums["tokens"]))).alias("reached_share"),
        ((F.col("taken_tokens") >= F.col("most")) & (F.col("most") < F.col("target_tokens"))).alias("short"),
    )
    return Mixture(mixed, shares)
