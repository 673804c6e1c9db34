"""Whole pipelines: reads to calls on target, with blocks between them in both streams."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbase.config import CallerOptions
from siftbase.operators.blocks import nonvariant_blocks
from siftbase.operators.calls import indel_sites, score_indels, score_snps, snp_sites
from siftbase.operators.coverage import coverage_runs
from siftbase.operators.intervals import merge_intervals
from siftbase.operators.joins import point_in_interval
from siftbase.operators.reads import KEYS, reference_pieces, tiles
from siftbase.session import cut

WEIGHTS = ["rr", "dp", "vr", "hit", "inside"]


class Calls(NamedTuple):
    """SNP and indel calls (1-based ``pos``); with ``gvcf`` the stretches of equal depth of both streams inside the regions (0-based)."""

    snps: DataFrame
    indels: DataFrame
    snp_surface: DataFrame | None
    indel_surface: DataFrame | None


def on_target(calls: DataFrame, segments: DataFrame | None) -> DataFrame:
    """calls (1-based pos) whose position lies in a segment (contig, seg_first, seg_second, 0-based); all without segments."""
    if segments is None:
        return calls
    rows = point_in_interval(calls.withColumn("_pos0", F.col("pos") - 1), segments, ["contig"], "_pos0", "seg_first", "seg_second")
    return rows.where("on_target").drop("_pos0", "on_target")


def whole_contigs(refseq: DataFrame) -> DataFrame:
    """Every contig of the reference as one segment."""
    return refseq.where("contig is not null").groupBy("contig").agg(F.lit(0).alias("seg_first"), F.max(F.col("tile_start") + F.length("seq") - 1).cast("int").alias("seg_second"))


def sample_regions(reads: DataFrame, segments: DataFrame, sample_id: int | None = None) -> DataFrame:
    """``KEYS``, first, last: the merged segments of the contigs that a sample has reads on, or of all contigs for the one ``sample_id``."""
    merged = merge_intervals(segments, ["contig"], "seg_first", "seg_second").where("kind = 'merged'").select("contig", F.col("seg_first").alias("first"), F.col("seg_second").alias("last"))
    if sample_id is not None:
        return merged.withColumn("sample_id", F.lit(sample_id).cast("long"))
    return merged.join(reads.select(*KEYS).distinct(), "contig")


def covered_regions(intervals: DataFrame) -> DataFrame:
    """``KEYS``, first, last: the stretches of each sample that reads cover."""
    return merge_intervals(intervals, KEYS, "first", "last").where("kind = 'merged'").drop("kind")


def surface(intervals: DataFrame, variants: DataFrame, calls: DataFrame, regions: DataFrame, o: CallerOptions) -> DataFrame:
    """``KEYS``, first, last, rr, dp, vr, called of each stretch of positions inside ``regions`` where all of them are constant.

    One sweep over intervals, variant reads (``KEYS``, first, last, vr, and dp
    where they count there too), called positions (``KEYS``, pos) and regions: no
    row per base, whatever the regions hold.
    """
    parts = [intervals.select(*KEYS, "first", "last", "rr", "dp"), variants, calls.select(*KEYS, F.col("pos").alias("first"), F.col("pos").alias("last"), F.lit(1).alias("hit")), regions.withColumn("inside", F.lit(1))]
    rows = None
    for part in parts:
        part = part.select(*KEYS, F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), *[(F.col(w) if w in part.columns else F.lit(0)).cast("long").alias(w) for w in WEIGHTS])
        rows = part if rows is None else rows.unionByName(part)
    runs = coverage_runs(rows, KEYS, WEIGHTS, cap=o.coverage_cap).where("inside > 0")
    return runs.select(*KEYS, F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "rr", "dp", "vr", (F.col("hit") > 0).alias("called"))


def blocks_of(surface_: DataFrame, refseq: DataFrame, o: CallerOptions) -> DataFrame:
    """SNK7: the blocks of a surface with the base at their start."""
    blocks = nonvariant_blocks(surface_, KEYS, "first", o=o, last="last").withColumn("_one", F.lit(1))
    return reference_pieces(blocks, tiles(refseq), "block_first", "_one").withColumnRenamed("_ref", "ref").drop("_from", "_one")


def no_variant_rows(surface_: DataFrame, refseq: DataFrame) -> DataFrame:
    """SNK8: a row for each base of a surface without a call; ``pos`` is 1-based. Its size is that of the regions, as its purpose is."""
    bases = surface_.where("not called").withColumn("_pos", F.explode(F.sequence("first", "last"))).withColumn("_one", F.lit(1))
    label = F.when(F.col("dp") == 0, "no_Reads").otherwise("no_VariantReads")
    rows = reference_pieces(bases.select(*KEYS, "_pos", "_one", "rr", "dp", "vr"), tiles(refseq), "_pos", "_one")
    return rows.select(*KEYS, (F.col("_pos") + 1).alias("pos"), F.col("_ref").alias("ref"), F.lit(0.0).alias("p"), label.alias("filters"), "vr", "rr", "dp")


def snp_surface(best: DataFrame, intervals: DataFrame, calls: DataFrame, regions: DataFrame, o: CallerOptions) -> DataFrame:
    variants = best.select(*KEYS, F.col("pos").alias("first"), F.col("pos").alias("last"), F.col("n").alias("vr"), F.col("n").alias("dp"))
    return surface(intervals, variants, calls.select(*KEYS, (F.col("pos") - 1).alias("pos")), regions, o)


def indel_surface(sites: DataFrame, intervals: DataFrame, calls: DataFrame, regions: DataFrame, o: CallerOptions) -> DataFrame:
    """Reads of a deletion count over its bases; a call takes the anchor base out of the blocks, so deleted bases are in the next one."""
    variants = sites.where("del").select(*KEYS, F.col("var_start").alias("first"), (F.col("var_start") + F.col("len") - 1).alias("last"), F.col("n").alias("vr"))
    return surface(intervals, variants, calls.select(*KEYS, (F.col("pos") - 1).alias("pos")).distinct(), regions, o)


def call(reads: DataFrame, refseq: DataFrame, segments: DataFrame | None = None, o: CallerOptions | None = None, sample_id: int | None = None, all_indels: bool = False) -> Calls:
    """Calls of both kinds from distinct reads, and with ``o.gvcf`` what lies between them.

    Without ``segments`` every contig of the reference is a region. Regions are
    those of the contigs a sample has reads on, or all for the one ``sample_id``.
    """
    o = o or CallerOptions()
    best, snp_cover = snp_sites(reads, refseq, o)
    snps = cut(score_snps(best, snp_cover, o))
    sites, indel_cover = indel_sites(reads, refseq, o, all_indels)
    indels = cut(score_indels(sites, indel_cover, refseq, o))
    kept = indels if o.legacy_indel_target else on_target(indels, segments)
    if not o.gvcf:
        return Calls(on_target(snps, segments), kept, None, None)
    regions = sample_regions(reads, whole_contigs(refseq) if segments is None else segments, sample_id)
    return Calls(on_target(snps, segments), kept, cut(snp_surface(best, snp_cover, snps, regions, o)), cut(indel_surface(sites, indel_cover, indels, regions, o)))
