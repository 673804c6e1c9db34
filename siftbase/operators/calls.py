"""Competing alleles at a site: majority, scoring, genotype and filters, for SNPs and indels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftbase.config import CallerOptions
from siftbase.functions import scalars as S
from siftbase.operators.coverage import coverage_at
from siftbase.operators.reads import KEYS, indel_walk, reference_windows, snp_walk, tiles
from siftbase.session import cut


def allele_counts(events: DataFrame, site: list[str]) -> DataFrame:
    """Per site and allele the reads, quality sum, forward reads and noisy-OR of their probabilities."""
    p = S.snp_logit(F.col("qual"), F.col("nqs"), F.col("rel_pos"))
    return (
        events.withColumn("_miss", 1.0 - p)
        .groupBy(*site, "allele")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n"),
            F.sum("qual").cast("long").alias("qsum"),
            F.count_if("fwd").cast("int").alias("fwd"),
            (1.0 - F.product("_miss")).alias("p_any"),
        )
        .withColumn("p", S.posterior(S.prior_bin(F.col("p_any"))))
    )


def majority(alleles: DataFrame, site: list[str], by: str = "posterior") -> DataFrame:
    """The allele with most reads per site, ``ties`` (alleles sharing the top count, if that is above 1) and ``all_reads``.

    Ties go to the higher posterior, then the earlier letter; with
    ``by='quality'`` to the last letter whose quality sum is above that of the
    first tied letter; with ``by='letter'`` to the earlier letter. A site has at
    most as many alleles as letters, so lists stay tiny.
    """
    row = F.struct(F.col("n"), "allele", "qsum", "fwd", "p_any", "p")
    sites = alleles.groupBy(*site).agg(F.max("n").alias("_top"), F.sum("n").cast("int").alias("all_reads"), F.sort_array(F.collect_list(F.struct("allele", row.alias("r")))).alias("_all"))
    tied = F.filter("_all", lambda x: x["r"]["n"] == F.col("_top"))
    if by == "quality":
        above = F.filter(tied, lambda x: x["r"]["qsum"] > F.get(tied, F.lit(0))["r"]["qsum"])
        pick = F.when((F.col("_top") > 1) & (F.size(above) > 0), F.element_at(above, -1)["r"]).otherwise(F.get(tied, F.lit(0))["r"])
    elif by == "posterior":
        best = F.array_max(F.transform(tied, lambda x: x["r"]["p"]))
        pick = F.when(F.col("_top") > 1, F.get(F.filter(tied, lambda x: x["r"]["p"] == best), F.lit(0))["r"]).otherwise(F.get(tied, F.lit(0))["r"])
    else:
        pick = F.get(tied, F.lit(0))["r"]
    ties = F.when(F.col("_top") > 1, F.size(tied)).otherwise(1)
    return sites.select(*site, pick.alias("_p"), ties.alias("ties"), "all_reads").select(*site, "_p.allele", "_p.n", "_p.qsum", "_p.fwd", "_p.p_any", "_p.p", "ties", "all_reads")


def snp_rows(sites: DataFrame, o: CallerOptions, keep: tuple[str, ...] = (*KEYS, "pos", "ref")) -> DataFrame:
    """Called rows from majorities joined with ``cov_rr`` and ``cov_dp``."""
    dp = F.col("n") + F.col("cov_rr")
    called = F.col("p") >= o.snp_min_p
    if o.force_reads is not None:
        called = called | ((F.col("n") >= o.force_reads) & (F.col("n") / dp >= o.force_fraction))
    if o.all_non_ref:
        called = F.lit(True)
    kept = sites.where((F.col("cov_dp") + F.col("all_reads") <= o.max_coverage) & called)
    return kept.select(
        *keep,
        F.col("allele").alias("alt"),
        S.snp_qual(F.col("p")).alias("qual"),
        S.snp_filters(F.col("p"), F.col("n"), dp, F.col("fwd"), o).alias("filters"),
        F.col("p"),
        (F.col("ties") > 1).alias("equal_majority"),
        S.snp_genotype(F.col("n"), dp, o).alias("gt"),
        F.col("n").alias("vr"),
        F.col("cov_rr").cast("int").alias("rr"),
        dp.cast("int").alias("dp"),
    )


def snp_sites(reads: DataFrame, refseq: DataFrame, o: CallerOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(the majority allele of each site, coverage intervals) from distinct reads; positions are 0-based."""
    o = o or CallerOptions()
    events, intervals = snp_walk(reads, refseq, o)
    site = [*KEYS, "pos", "ref"]
    return cut(majority(allele_counts(events, site), site, "posterior" if o.scavenge else "quality")), intervals  # sites are few beside reads


def call_snps(reads: DataFrame, refseq: DataFrame, o: CallerOptions | None = None) -> DataFrame:
    """SNP calls per sample from distinct reads; ``pos`` is 1-based."""
    return score_snps(*snp_sites(reads, refseq, o), o)


def score_snps(best: DataFrame, intervals: DataFrame, o: CallerOptions | None = None) -> DataFrame:
    """Called rows from snp_sites."""
    o = o or CallerOptions()
    cover = coverage_at(intervals, best, KEYS, ["rr", "dp"], cap=o.coverage_cap).withColumnsRenamed({"rr": "cov_rr", "dp": "cov_dp"})
    calls = snp_rows(best.join(cover, [*KEYS, "pos"]), o)
    return calls.withColumn("pos", F.col("pos") + 1)


def merge_indels(events: DataFrame) -> DataFrame:
    """One row per sample, contig, start and indel with counts, strands and means."""
    return (
        events.groupBy(*KEYS, "var_start", "id", "del", "len", "bases")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n"),
            F.bool_or("fwd").alias("any_fwd"),
            F.bool_or(~F.col("fwd")).alias("any_rev"),
            F.count_if("near_end").alias("near_ends"),
            F.avg("nbq").alias("mean_nbq"),
            F.avg("mapq").alias("mean_mapq"),
            F.avg("var_rate").alias("mean_var_rate"),
        )
        .withColumn("near_end_ratio", F.col("near_ends") / F.col("n"))
    )


def top_indels(alleles: DataFrame) -> DataFrame:
    """The indel with most reads per start, ties to the smallest id as text, and ``all_reads`` there."""
    best = F.min_by(F.struct(*[c for c in alleles.columns if c not in (*KEYS, "var_start")]), F.struct((-F.col("n")).alias("a"), F.col("id").alias("b")))
    return alleles.groupBy(*KEYS, "var_start").agg(best.alias("_t"), F.sum("n").cast("int").alias("all_reads")).select(*KEYS, "var_start", "_t.*", "all_reads")


def with_entropy(sites: DataFrame, refseq: DataFrame) -> DataFrame:
    """X15 from the reference around each site."""
    key = [*KEYS, "var_start", "id"]
    start, length = S.entropy_window(F.col("var_start"), F.col("len"), F.col("del"))
    rows = sites.withColumn("_ws", start.cast("int")).withColumn("_wl", length.cast("int"))
    windows = reference_windows(rows, tiles(refseq), key, "_ws", "_wl", "_window")
    return sites.join(windows, key, "left").withColumn("entropy", S.local_entropy(F.coalesce("_window", F.lit("")), F.col("len"))).drop("_window")


def indel_sites(reads: DataFrame, refseq: DataFrame, o: CallerOptions | None = None, all_indels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the indel with most reads of each start, or every one; coverage intervals) from distinct reads."""
    events, intervals = indel_walk(reads, refseq, o)
    alleles = merge_indels(events)
    w = Window.partitionBy(*KEYS, "var_start")
    sites = alleles.withColumn("all_reads", F.sum("n").over(w).cast("int")) if all_indels else top_indels(alleles)
    return cut(sites), intervals  # sites are few beside reads, and are needed five times


def call_indels(reads: DataFrame, refseq: DataFrame, o: CallerOptions | None = None, all_indels: bool = False) -> DataFrame:
    """Indel calls per sample from distinct reads; ``pos`` is the 1-based anchor.

    ``all_indels`` keeps every indel of a start instead of the one with most reads.
    """
    return score_indels(*indel_sites(reads, refseq, o, all_indels), refseq, o)


def score_indels(sites: DataFrame, intervals: DataFrame, refseq: DataFrame, o: CallerOptions | None = None) -> DataFrame:
    """Called rows from indel_sites."""
    o = o or CallerOptions()
    sites = cut(with_entropy(sites, refseq)).withColumn("cov_pos", F.when(F.col("del"), F.col("var_start")).otherwise(F.col("var_start") - 1))
    cover = coverage_at(intervals, sites.select(*KEYS, "cov_pos"), KEYS, ["rr", "rr_ins", "dp"], "cov_pos", o.coverage_cap)
    rows = sites.join(cover, [*KEYS, "cov_pos"])
    ref_reads = F.when(F.col("del"), F.col("rr")).otherwise(F.greatest(F.lit(0), F.col("rr_ins") - F.col("all_reads")))
    rows = rows.withColumn("p", score_indel(o)).withColumn("ref_reads", ref_reads).withColumn("qual", S.indel_qual(F.col("p")))
    kept = F.lit(True) if o.all_non_ref else (F.col("qual") != 0) & (F.col("p") > o.indel_min_p)
    if o.max_coverage:
        kept = kept & (F.col("dp") <= o.max_coverage)
    rows = rows.where(kept)
    key = [*KEYS, "var_start", "id"]
    spans = rows.withColumn("_as", F.col("var_start") - 1).withColumn("_al", F.when(F.col("del"), F.col("len") + 1).otherwise(1)).where("_as >= 0")
    anchored = rows.join(reference_windows(spans, tiles(refseq), key, "_as", "_al", "_anchor"), key)
    return anchored.select(
        *KEYS, F.col("var_start").alias("pos"), F.col("_anchor").alias("ref"),
        F.when(F.col("del"), F.substring("_anchor", 1, 1)).otherwise(F.concat("_anchor", "bases")).alias("alt"), "qual",
        S.indel_filters(F.col("p"), F.col("n"), F.col("dp"), F.col("any_fwd") & F.col("any_rev"), F.col("near_end_ratio"), o).alias("filters"),
        "p", S.indel_genotype(F.col("n"), F.col("ref_reads"), F.col("dp"), o).alias("gt"),
        F.col("n").alias("vr"), F.col("ref_reads").cast("int").alias("rr"), F.col("dp").cast("int").alias("dp"),
    )


def score_indel(o: CallerOptions) -> Column:
    strand = F.col("any_fwd") & F.col("any_rev")
    nbq = F.coalesce("mean_nbq", F.lit(0.0))
    if o.wgs_indel:
        return S.indel_logit_wgs(F.col("entropy"), strand, nbq, F.col("mean_mapq"), F.col("mean_var_rate"), F.col("n"), F.col("dp"))
    return S.indel_logit(F.col("entropy"), strand, nbq, F.col("n"), F.col("dp"))
