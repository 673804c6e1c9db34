"""Registered queries of the core and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbase.config import CallerOptions
from siftbase.functions import scalars as S
from siftbase.operators.blocks import nonvariant_blocks
from siftbase.operators.calls import allele_counts, call_indels, call_snps, indel_sites, majority, merge_indels, score_indels, snp_rows, top_indels, with_entropy
from siftbase.operators.coverage import coverage_at, coverage_runs
from siftbase.operators.intervals import merge_intervals, previous_gap
from siftbase.operators.joins import overlap_join, point_in_interval, with_known, with_targets
from siftbase.operators.reads import distinct_reads, indel_walk, mismatch_types, op_sum, reference_pieces, snp_walk, tiles, usable
from siftbase.operators.skew import heavy_keys, skew_join, skew_totals
from siftbase.plans import sql as Q
from siftbase.plans.caller import covered_regions, indel_surface
from siftbase.plans.evidence import evidence, read_spans
from siftbase.session import distinct_rows, scratch, table
from siftbase.sinks.vcf import block_record, indel_record, snp_record, vcf_lines
from siftbase.sources.text import known_indels, parse_bed
from siftbase.streaming.caller import FLUSH, final_alleles, open_sites, stream_alleles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__.rstrip("_")] = f
        if sql:
            SQL[f.__name__.rstrip("_")] = sql
        return f

    return add


@query("""
select contig from var_records where contig is not null group by contig
having 25 * count(*) >= (select count(*) from var_records)""")
def p2_found(spark, sf):
    """Contigs with at least a twenty-fifth of the rows as stored, from the counts of all contigs."""
    counts, total = skew_totals(table(spark, sf, "var_records"), "contig", 0.01, [F.count(F.lit(1)).alias("records")])
    return counts.where(F.col("contig").isNotNull() & (25 * F.col("records") >= total)).select("contig")


@query("""
with v as (select distinct rec_id, contig, alt_allele, dp, vr from var_records)
select v.contig, any_value(c.contig_len) as contig_len, any_value(c.ord) as ord, count(*) as records,
  count(*) filter (where alt_allele <> '.') as called_sites, cast(sum(dp) as bigint) as sum_dp,
  cast(sum(vr) as bigint) as sum_vr, max(dp) as max_dp
from v left join contigs c on v.contig = c.contig group by v.contig""")
def p2_contig_stats(spark, sf):
    """Records, called sites and sums per contig, each rec_id once; the contig's own data joined in without skew."""
    raw = table(spark, sf, "var_records")
    heavy, _ = heavy_keys(raw, "contig", 0.01)
    rows = distinct_rows(raw, "rec_id", "contig", "alt_allele", "dp", "vr")
    joined = skew_join(rows, table(spark, sf, "contigs"), "contig", how="left", heavy=heavy)
    return joined.groupBy("contig").agg(
        F.max("contig_len").alias("contig_len"),
        F.max("ord").alias("ord"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("alt_allele") != ".").alias("called_sites"),
        F.sum("dp").alias("sum_dp"),
        F.sum("vr").alias("sum_vr"),
        F.max("dp").alias("max_dp"),
    )


@query("""
with v as (select distinct rec_id, contig, pos, ref_allele from var_records where contig is not null and pos is not null),
t as (select distinct contig, tile_start, seq from refseq where contig is not null and tile_start is not null and seq is not null)
select v.contig, v.pos // 5000 as tile_no, count(*) as records, count(*) filter (where substr(upper(ref_allele), 1, 1) = upper(substr(seq, cast(pos - 1 - tile_start as int) + 1, 1))) as agreeing
from v join t on v.contig = t.contig and t.tile_start = 5000 * ((v.pos - 1) // 5000) where v.pos >= 1 group by 1, 2""")
def p2_tile_agreement(spark, sf):
    """Records per tile of the reference, and how many have its base; many short keys and a wide dimension, so that both ways of the join run."""
    rows = table(spark, sf, "var_records").where("contig is not null and pos >= 1").select("rec_id", "contig", "pos", "ref_allele")
    rows = distinct_rows(rows, "rec_id", "contig", "pos", "ref_allele").withColumn("tile", F.concat_ws(":", "contig", (5000 * F.floor((F.col("pos") - 1) / 5000)).cast("string")))
    tiles_ = table(spark, sf, "refseq").where("contig is not null and tile_start is not null and seq is not null").select(F.concat_ws(":", "contig", F.col("tile_start").cast("string")).alias("tile"), "tile_start", "seq").distinct()
    met = skew_join(rows, tiles_, "tile", share=0.004, dim_rows=2)
    same = F.substring(F.upper("ref_allele"), 1, 1) == F.upper(F.substring("seq", F.col("pos") - F.col("tile_start"), F.lit(1)))
    return met.groupBy("contig", F.floor(F.col("pos") / 5000).alias("tile_no")).agg(F.count(F.lit(1)).alias("records"), F.count_if(same).alias("agreeing"))


VALID_TARGETS = """valid as (select distinct panel_id, contig, coord_first, coord_second from targets
  where contig is not null and coord_first is not null and coord_second is not null and coord_first <= coord_second)"""


@query(f"""
with {VALID_TARGETS},
b as (select *, max(coord_second) over (partition by panel_id, contig order by coord_first, coord_second
  rows between unbounded preceding and 1 preceding) as before from valid),
i as (select *, sum(case when before is null or coord_first > before + 1 then 1 else 0 end)
  over (partition by panel_id, contig order by coord_first, coord_second rows unbounded preceding) as island from b),
m as (select panel_id, contig, island, min(coord_first) as a, max(coord_second) as z from i group by all)
select panel_id, contig, 'merged' as kind, a as coord_first, z as coord_second from m
union all
select panel_id, contig, 'gap', before + 1, coord_first - 1 from b where coord_first > before + 1""")
def p5_found(spark, sf):
    """Covered periods of each panel and contig, and the gaps between them."""
    rows = table(spark, sf, "targets").where("contig is not null")
    return merge_intervals(rows, ["panel_id", "contig"], "coord_first", "coord_second")


# Evidence over the relational tables ------------------------------------------------------------

SITE = "contig, pos, ref"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).where("allele <> ref")


def _alleles(spark: SparkSession, sf: str) -> DataFrame:
    return allele_counts(_events(spark, sf), ["contig", "pos", "ref"])


def _best(spark: SparkSession, sf: str, by: str = "posterior") -> DataFrame:
    return majority(_alleles(spark, sf), ["contig", "pos", "ref"], by)


def _with_cover(spark: SparkSession, sf: str) -> DataFrame:
    cover = evidence(spark, sf).groupBy("contig", "pos").agg(F.count_if(F.col("allele") == F.col("ref")).alias("cov_rr"))
    return _best(spark, sf).join(cover, ["contig", "pos"]).withColumn("cov_dp", F.col("cov_rr"))


@query(f"with {Q.EV}, {Q.alleles(SITE)} select {SITE}, allele, cast(n as int) as n, cast(qsum as bigint) as qsum, cast(fwd as int) as fwd from al")
def allele_counts_(spark, sf):
    """A4, A10: reads, quality sums and forward reads per site and allele."""
    return _alleles(spark, sf).select("contig", "pos", "ref", "allele", "n", "qsum", "fwd")


@query(f"with {Q.EV}, {Q.alleles(SITE)} select {SITE}, allele, round(p_any, 6) as p_any from al")
def noisy_or(spark, sf):
    """Probability that any read of the allele is right."""
    return _alleles(spark, sf).select("contig", "pos", "ref", "allele", F.round("p_any", 6).alias("p_any"))


@query(f"with {Q.EV}, {Q.alleles(SITE)} select {SITE}, allele, cast(least(9, floor(round(10 * p_any, 9))) as int) as bin, round(post, 9) as post, {Q.SNP_Q} as qual from al")
def snp_posterior(spark, sf):
    """Bin, posterior and quality of each allele."""
    return _alleles(spark, sf).select("contig", "pos", "ref", "allele", S.prior_bin(F.col("p_any")).alias("bin"), F.round("p", 9).alias("post"), S.snp_qual(F.col("p")).alias("qual"))


@query(f"with {Q.EV}, {Q.alleles(SITE)}, m as (select {SITE}, allele, n, row_number() over (partition by {SITE} order by n desc, allele) as rk from al) select {SITE}, allele, cast(n as int) as n from m where rk = 1")
def majority_allele(spark, sf):
    """A5: the allele with most reads, the earlier letter of equals."""
    return _best(spark, sf, "letter").select("contig", "pos", "ref", "allele", "n")


@query(f"with {Q.EV}, {Q.alleles(SITE)}, m as (select *, max(n) over (partition by {SITE}) as top from al) select {SITE}, cast(case when max(top) > 1 then count(*) else 1 end as int) as ties from m where n = top group by {SITE}")
def tie_count(spark, sf):
    """Alleles that share a top count above one."""
    return _best(spark, sf).select("contig", "pos", "ref", "ties")


@query(f"with {Q.EV}, {Q.alleles(SITE)}, {Q.majority(SITE)} select {SITE}, allele, cast(n as int) as n, round(post, 9) as post from best")
def tiebreak_posterior(spark, sf):
    """Equal majorities told apart by posterior."""
    return _best(spark, sf).select("contig", "pos", "ref", "allele", "n", F.round("p", 9).alias("post"))


@query(f"""with {Q.EV}, {Q.alleles(SITE)}, m as (select *, max(n) over (partition by {SITE}) as top from al),
t as (select *, first_value(qsum) over (partition by {SITE} order by allele) as bar, min(allele) over (partition by {SITE}) as low from m where n = top)
select {SITE}, coalesce(max(case when qsum > bar and top > 1 then allele end), min(low)) as allele from t group by {SITE}""")
def tiebreak_quality(spark, sf):
    """Equal majorities told apart by base quality; the bar stays at the first."""
    return _best(spark, sf, "quality").select("contig", "pos", "ref", "allele")


SNP_SQL = f"""with {Q.EV}, {Q.alleles(SITE)}, {Q.majority(SITE)},
c as (select best.*, c.rr, n + c.rr as dp from best join cover c using (contig, pos) where c.rr + all_reads <= 8000 and post >= 0.109E0), d as (select *, {Q.SNP_F} as f from c)
select {SITE}, allele as alt, {Q.SNP_Q} as qual, {Q.FILTERS} as filters, round(post, 9) as p, ties > 1 as equal_majority, {Q.SNP_GT} as gt, cast(n as int) as vr, cast(rr as int) as rr, cast(dp as int) as dp from d"""


def _snps(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_cover(spark, sf)
    return snp_rows(rows, CallerOptions(), ("contig", "pos", "ref")).withColumn("p", F.round("p", 9))


@query(SNP_SQL)
def snp_calls(spark, sf):
    """The caller over the relational evidence: which base, how sure, what genotype."""
    return _snps(spark, sf)


@query(f"select filters, gt, count(*) as n, cast(sum(dp) as bigint) as sum_dp from ({SNP_SQL}) x group by filters, gt")
def snp_filters_genotypes(spark, sf):
    """How often each set of labels and genotype comes."""
    return _snps(spark, sf).groupBy("filters", "gt").agg(F.count(F.lit(1)).alias("n"), F.sum("dp").alias("sum_dp"))


def _span_sql(weight: str, cap: str = "{}") -> str:
    return f"""with s as (select l_suppkey % 5 as contig, l_partkey as a, l_partkey + cast(l_quantity as int) as z, {weight} as w from lineitem),
d as (select contig, a as pos, w from s union all select contig, z, -w from s), p as (select contig, pos, sum(w) as w from d group by 1, 2),
c as (select contig, pos, sum(w) over (partition by contig order by pos) as depth, lead(pos) over (partition by contig order by pos) as nxt from p)
select contig, pos as first, nxt - 1 as last, cast({cap.format("depth")} as bigint) as depth from c where depth <> 0 and nxt is not null"""


@query(_span_sql("1"))
def coverage_sweep(spark, sf):
    """Coverage of overlapping intervals as runs of constant depth."""
    return coverage_runs(read_spans(spark, sf).select("contig", "first", "last", "depth"), ["contig"], ["depth"])


@query(_span_sql("1", "least({}, 12)"))
def coverage_capped(spark, sf):
    """A1 with a cap."""
    return coverage_runs(read_spans(spark, sf).select("contig", "first", "last", "depth"), ["contig"], ["depth"], cap=12)


@query(_span_sql("l_linenumber"))
def coverage_weighted(spark, sf):
    """A2: intervals that count more than once."""
    spans = read_spans(spark, sf).select("contig", "first", "last", F.col("weight").alias("depth"))
    return coverage_runs(spans, ["contig"], ["depth"])


# Aligned reads ----------------------------------------------------------------------------------


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_reads(table(spark, sf, "aligned_reads"))


@query(f"with {Q.READS.format(mapq=1)} select sample_id, contig, qname, flag, pos, mapq, nm, cast(lq as int) as l_qseq from ok")
def read_filter(spark, sf):
    """F1 to F4 on reads counted once."""
    return _reads(spark, sf).where(usable("snp", CallerOptions())).select("sample_id", "contig", "qname", "flag", "pos", "mapq", "nm", F.length("seq").alias("l_qseq"))


@query(f"with {Q.SNP_READS} select sample_id, contig, qname, flag, pos, ref, allele, qual, round(rel_pos, 9) as rel_pos, nqs, fwd from events")
def snp_events(spark, sf):
    """Mismatches of reads with what scores them."""
    events, _ = snp_walk(_reads(spark, sf), table(spark, sf, "refseq"))
    return events.withColumn("rel_pos", F.round("rel_pos", 9))


@query(f"""with {Q.SNP_READS}, w as (select *, lag(pos, 1) over s as p1, lag(ref, 1) over s as f1, lag(allele, 1) over s as a1, lag(pos, 2) over s as p2, lag(ref, 2) over s as f2, lag(allele, 2) over s as a2,
  lead(pos, 1) over s as p3, lead(ref, 1) over s as f3, lead(allele, 1) over s as a3, lead(pos, 2) over s as p4, lead(ref, 2) over s as f4, lead(allele, 2) over s as a4
  from events window s as (partition by sample_id, contig, qname, flag order by pos))
select sample_id, contig, qname, pos, ref, allele, case
  when (pos - p1 <= 2 and f1 = allele and a1 = ref) or (pos - p2 <= 2 and f2 = allele and a2 = ref) or (p3 - pos <= 2 and f3 = allele and a3 = ref) or (p4 - pos <= 2 and f4 = allele and a4 = ref) then 'SWAP'
  when pos - p1 = 1 or p3 - pos = 1 then 'MNP' else 'SNP' end as type from w""")
def mismatch_type(spark, sf):
    """Single, multiple or swapped mismatches."""
    events, _ = snp_walk(_reads(spark, sf), table(spark, sf, "refseq"))
    return mismatch_types(events).select("sample_id", "contig", "qname", "pos", "ref", "allele", "type")


@query(f"with {Q.SNP_READS} select sample_id, contig, pos, rr, dp from cov where pos in (select pos from events e where e.sample_id = cov.sample_id and e.contig = cov.contig and e.pos = cov.pos)")
def snp_coverage_at(spark, sf):
    """Reference and total coverage where there is SNP evidence."""
    events, intervals = snp_walk(_reads(spark, sf), table(spark, sf, "refseq"))
    return coverage_at(intervals, events, ["sample_id", "contig"], ["rr", "dp"])


RSITE = "sample_id, contig, pos, ref"


@query(f"""with {Q.SNP_READS}, {Q.alleles(RSITE)}, {Q.majority(RSITE)},
c as (select best.*, coalesce(cov.rr, 0) as rr, n + coalesce(cov.rr, 0) as dp from best left join cov using (sample_id, contig, pos) where coalesce(cov.dp, 0) + all_reads <= 8000 and post >= 0.109E0), d as (select *, {Q.SNP_F} as f from c)
select sample_id, contig, cast(pos + 1 as int) as pos, ref, allele as alt, {Q.SNP_Q} as qual, {Q.FILTERS} as filters, round(post, 9) as p, ties > 1 as equal_majority, {Q.SNP_GT} as gt, cast(n as int) as vr, cast(rr as int) as rr, cast(dp as int) as dp from d""")
def read_snp_calls(spark, sf):
    """SNP calls of every sample from its aligned reads."""
    return call_snps(_reads(spark, sf), table(spark, sf, "refseq")).withColumn("p", F.round("p", 9))


@query(f"""with {Q.INDEL_READS} select sample_id, contig, var_start, del, len, id, fwd, mapq, near_end, nbq, round(var_rate, 6) as var_rate, count(*) as n from ievents group by all""")
def indel_events(spark, sf):
    """Insertions and deletions of reads with what scores them."""
    events, _ = indel_walk(_reads(spark, sf), table(spark, sf, "refseq"))
    events = events.withColumn("var_rate", F.round("var_rate", 6))
    return events.groupBy("sample_id", "contig", "var_start", "del", "len", "id", "fwd", "mapq", "near_end", "nbq", "var_rate").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {Q.INDEL_READS} select sample_id, contig, var_start, id, cast(n as int) as n, any_fwd and any_rev as both_strands, near_ends, round(mean_nbq, 6) as mean_nbq, round(mean_mapq, 6) as mean_mapq, round(mean_var_rate, 6) as mean_var_rate from im""")
def indel_merge(spark, sf):
    """Indels merged over reads."""
    events, _ = indel_walk(_reads(spark, sf), table(spark, sf, "refseq"))
    m = merge_indels(events)
    means = [F.round(c, 6).alias(c) for c in ("mean_nbq", "mean_mapq", "mean_var_rate")]
    return m.select("sample_id", "contig", "var_start", "id", "n", (F.col("any_fwd") & F.col("any_rev")).alias("both_strands"), "near_ends", *means)


@query(f"with {Q.INDEL_READS} select sample_id, contig, var_start, id, cast(n as int) as n, cast(all_reads as int) as all_reads from top")
def indel_top(spark, sf):
    """The indel with most reads per start, and all reads there."""
    events, _ = indel_walk(_reads(spark, sf), table(spark, sf, "refseq"))
    return top_indels(merge_indels(events)).select("sample_id", "contig", "var_start", "id", "n", "all_reads")


@query(f"with {Q.INDEL_READS} select sample_id, contig, var_start, id, round(entropy, 6) as entropy from te")
def kmer_entropy(spark, sf):
    """Entropy of the reference around each indel."""
    events, _ = indel_walk(_reads(spark, sf), table(spark, sf, "refseq"))
    return with_entropy(top_indels(merge_indels(events)), table(spark, sf, "refseq")).select("sample_id", "contig", "var_start", "id", F.round("entropy", 6).alias("entropy"))


@query(Q.indel_calls(Q.P_INDEL))
def indel_calls(spark, sf):
    """Indel calls of every sample from its aligned reads."""
    return call_indels(_reads(spark, sf), table(spark, sf, "refseq")).withColumn("p", F.round("p", 6))


@query(Q.indel_calls(Q.P_WGS))
def indel_calls_wgs(spark, sf):
    """The same with the seven-coefficient model."""
    return call_indels(_reads(spark, sf), table(spark, sf, "refseq"), CallerOptions(wgs_indel=True)).withColumn("p", F.round("p", 6))


@query(f"""with {Q.INDEL_READS}, d as (select sample_id, contig, a as pos, rr, rr_ins, dp from spans union all select sample_id, contig, z + 1, -rr, -rr_ins, -dp from spans),
p as (select sample_id, contig, pos, sum(rr) as rr, sum(rr_ins) as rr_ins, sum(dp) as dp from d group by 1, 2, 3),
c as (select sample_id, contig, pos, sum(rr) over w as rr, sum(rr_ins) over w as rr_ins, sum(dp) over w as dp, lead(pos) over w as nxt from p window w as (partition by sample_id, contig order by pos))
select sample_id, contig, cast(pos as bigint) as first, cast(nxt - 1 as bigint) as last, cast(rr as bigint) as rr, cast(rr_ins as bigint) as rr_ins, cast(dp as bigint) as dp from c where nxt is not null and (rr <> 0 or rr_ins <> 0 or dp <> 0)""")
def depth_table(spark, sf):
    """SNK9, D7: coverage of all reads as runs of constant depth."""
    _, intervals = indel_walk(_reads(spark, sf), table(spark, sf, "refseq"))
    return coverage_runs(intervals, ["sample_id", "contig"], ["rr", "rr_ins", "dp"])


# Variant records and targets ----------------------------------------------------------------------


def _records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "var_records").where("contig is not null and pos is not null")
    return distinct_rows(rows, "rec_id", "sample_id", "contig", "pos", "ref_allele", "alt_allele", "dp", "rr", "vr", "p")


@query(Q.BLOCKS)
def gvcf_blocks(spark, sf):
    """The records between calls as blocks of nearly constant depth."""
    rows = _records(spark, sf).withColumn("called", F.col("alt_allele") != ".")
    b = nonvariant_blocks(rows, ["sample_id", "contig"])
    return b.select("sample_id", "contig", "block_first", "block_last", "reason", "n_stats", "dp_min", "dp_max", F.round("dp_mean", 6).alias("dp_mean"), F.round("dp_sd", 6).alias("dp_sd"), "rr_min", "rr_max", "vr_min", "vr_max")


@query(Q.INDEL_BLOCKS)
def indel_gvcf(spark, sf):
    """W1 in the indel stream: blocks between indel calls over what each sample's reads cover."""
    reads, ref, o = _reads(spark, sf), table(spark, sf, "refseq"), CallerOptions()
    sites, intervals = indel_sites(reads, ref, o)
    surface = indel_surface(sites, intervals, score_indels(sites, intervals, ref, o), covered_regions(intervals), o)
    b = nonvariant_blocks(surface, ["sample_id", "contig"], "first", last="last")
    return b.select("sample_id", "contig", "block_first", "block_last", "reason", "n_stats", "dp_min", "dp_max", F.round("dp_mean", 6).alias("dp_mean"), F.round("dp_sd", 6).alias("dp_sd"), "rr_min", "rr_max", "vr_min", "vr_max")


@query("""with c as (select distinct sample_id, contig, pos from var_records where contig is not null and pos is not null and alt_allele <> '.'),
g as (select *, lag(pos) over (partition by sample_id, contig order by pos) + 1 as gap_first, pos - 1 as gap_second from c) select sample_id, contig, pos, gap_first, gap_second from g""")
def call_gaps(spark, sf):
    """The gap between a call and the call before it."""
    calls = _records(spark, sf).where("alt_allele <> '.'").select("sample_id", "contig", "pos").distinct()
    return previous_gap(calls, ["sample_id", "contig"], "pos")


@query("""with v as (select distinct rec_id, sample_id, contig, pos, ref_allele, alt_allele, dp, rr, vr, p from var_records where contig is not null and pos is not null),
c as (select distinct sample_id, contig, pos from v where alt_allele <> '.')
select rec_id, v.sample_id, v.contig, v.pos, ref_allele as ref, p, case when dp = 0 then 'no_Reads' else 'no_VariantReads' end as filters, vr, rr, dp from v anti join c using (sample_id, contig, pos)""")
def novar_sites(spark, sf):
    """SNK8: a row for each position without a call."""
    rows = _records(spark, sf)
    called = rows.where("alt_allele <> '.'").select("sample_id", "contig", "pos").distinct()
    label = F.when(F.col("dp") == 0, "no_Reads").otherwise("no_VariantReads")
    return rows.join(called, ["sample_id", "contig", "pos"], "left_anti").select("rec_id", "sample_id", "contig", "pos", F.col("ref_allele").alias("ref"), "p", label.alias("filters"), "vr", "rr", "dp")


@query("""with t as (select distinct target_id, contig, coord_first, coord_second from targets where contig is not null and coord_first <= coord_second),
r as (select distinct sample_id, contig, qname, flag, pos, greatest(1, coalesce(list_sum([x.len for x in cigar if x.op in ('M','D','N','=','X')]), 0)) as n from aligned_reads where pos >= 0)
select target_id, contig, count(*) as reads from t join r using (contig) where pos <= coord_second and pos + n - 1 >= coord_first group by 1, 2""")
def target_overlap(spark, sf):
    """J4, SRC2: reads that overlap each target with the span of their CIGAR; a read without one has its first base only."""
    t = distinct_rows(table(spark, sf, "targets").where("contig is not null"), "target_id", "contig", "coord_first", "coord_second")
    span = F.greatest(F.coalesce(op_sum("M", "D", "N", "=", "X"), F.lit(0)), F.lit(1))
    r = table(spark, sf, "aligned_reads").where("pos >= 0").select("sample_id", "contig", "qname", "flag", "pos", (F.col("pos") + span - 1).alias("read_last")).distinct()
    return overlap_join(t, r, ["contig"], ("coord_first", "coord_second"), ("pos", "read_last")).groupBy("target_id", "contig").agg(F.count(F.lit(1)).alias("reads"))


@query("""select contig, contig_len, ord from contigs where contig in (select contig from targets where contig is not null and coord_first <= coord_second)""")
def target_contigs(spark, sf):
    """Contigs with a target."""
    return with_targets(table(spark, sf, "contigs"), table(spark, sf, "targets"))


@query("""with c as (select distinct rec_id, sample_id, contig, pos from var_records where contig is not null and pos is not null and alt_allele <> '.'),
t as (select distinct panel_id, contig, coord_first, coord_second from targets where contig is not null and coord_first <= coord_second)
select rec_id, c.sample_id, c.contig, c.pos, exists (select 1 from t where t.panel_id = s.panel_id and t.contig = c.contig and c.pos - 1 between coord_first and coord_second) as on_target
from c join samples s using (sample_id)""")
def point_in_target(spark, sf):
    """Calls inside or outside the targets of their sample's panel."""
    calls = _records(spark, sf).where("alt_allele <> '.'").select("rec_id", "sample_id", "contig", "pos").distinct()
    calls = calls.join(table(spark, sf, "samples").select("sample_id", "panel_id"), "sample_id").withColumn("_pos0", F.col("pos") - 1)
    targets = table(spark, sf, "targets").where("contig is not null")
    return point_in_interval(calls, targets, ["panel_id", "contig"], "_pos0", "coord_first", "coord_second").select("rec_id", "sample_id", "contig", "pos", "on_target")


@query(r"""with f as (select target_id, bed_line, regexp_split_to_array(trim(bed_line), '\s+') as f from targets)
select distinct target_id, f[1] as contig, cast(f[2] as int) - 1 as seg_first, cast(f[3] as int) - 1 as seg_second from f
where len(f) >= 3 and not starts_with(trim(bed_line), '#') and regexp_full_match(f[2], '\d+') and regexp_full_match(f[3], '\d+')""")
def bed_parse(spark, sf):
    """SRC6: target lines as segments; short lines and comments are left out."""
    return parse_bed(table(spark, sf, "targets").select("target_id", "bed_line"), "bed_line").select("target_id", "contig", "seg_first", "seg_second").distinct()


@query(f"""with x as ({Q.indel_calls(Q.P_INDEL)}), k as (select contig, case when length(ref_allele) > length(alt_allele) then concat(pos, 'D', length(ref_allele) - length(alt_allele)) else concat(pos, 'I', substr(alt_allele, length(ref_allele) + 1)) end as key,
  max(coalesce(try_cast(nullif(regexp_extract(coalesce(info, ''), '(?:^|;)GMAF=([0-9.eE+-]+)', 1), '') as double), 0.0001)) as af
  from known_indels where contig is not null and pos is not null and alt_allele not like '%,%' and length(ref_allele) <> length(alt_allele) group by 1, 2)
select sample_id, x.contig, x.pos, x.ref, x.alt, k.af from x left join k on k.contig = x.contig and k.key = case when length(x.ref) > length(x.alt) then concat(x.pos, 'D', length(x.ref) - length(x.alt)) else concat(x.pos, 'I', substr(x.alt, length(x.ref) + 1)) end""")
def indel_known(spark, sf):
    """Indel calls with the frequency of the known indel they are."""
    calls = call_indels(_reads(spark, sf), table(spark, sf, "refseq"))
    return with_known(calls, known_indels(table(spark, sf, "known_indels"))).select("sample_id", "contig", "pos", "ref", "alt", "af")


@query(f"""with x as ({Q.indel_calls(Q.P_INDEL)}) select concat_ws(chr(9), contig, pos, '.', ref, alt, qual, filters, gt || ':' || vr || ':' || rr || ':' || dp || ':.') as line from x
union all select concat_ws(chr(9), contig, pos, '.', ref, alt, qual, filters, gt || ':' || vr || ':' || rr || ':' || dp || ':.') from (
with {Q.SNP_READS}, {Q.alleles(RSITE)}, {Q.majority(RSITE)},
c as (select best.*, coalesce(cov.rr, 0) as rr, n + coalesce(cov.rr, 0) as dp from best left join cov using (sample_id, contig, pos) where coalesce(cov.dp, 0) + all_reads <= 8000 and post >= 0.109E0), d as (select *, {Q.SNP_F} as f from c)
select contig, cast(pos + 1 as int) as pos, ref, allele as alt, {Q.SNP_Q} as qual, {Q.FILTERS} as filters, {Q.SNP_GT} as gt, cast(n as int) as vr, cast(rr as int) as rr, cast(dp as int) as dp from d) y""")
def vcf_union(spark, sf):
    """SNK5, SNK6, union: lines of both kinds of calls, without the probability's text."""
    reads, ref, contigs = _reads(spark, sf), table(spark, sf, "refseq"), table(spark, sf, "contigs")
    both = vcf_lines(call_snps(reads, ref), snp_record(), contigs).unionByName(vcf_lines(call_indels(reads, ref), indel_record(), contigs))
    f = F.split("line", "\t")
    return both.select(F.concat_ws("\t", *[f[i] for i in range(7)], f[9]).alias("line"))


@query(Q.BLOCK_LINES)
def gvcf_lines(spark, sf):
    """SNK7: the blocks of all samples as VCF lines with their reference base."""
    rows = _records(spark, sf).withColumn("called", F.col("alt_allele") != ".")
    blocks = nonvariant_blocks(rows, ["sample_id", "contig"]).withColumn("_from0", F.col("block_first") - 1).withColumn("_one", F.lit(1))
    based = reference_pieces(blocks, tiles(table(spark, sf, "refseq")), "_from0", "_one").withColumn("ref", F.col("_ref"))
    return vcf_lines(based, block_record(), table(spark, sf, "contigs"), "block_first")


@query("""with e as (select event_type as contig, cast(floor(epoch(ts) / 3600) as bigint) as pos, substr('ACGT', cast(event_id % 4 as int) + 1, 1) as allele, cast(floor(value) as bigint) % 41 as qual, event_id % 3 <> 0 as nqs, (event_id % 100) / 100.0E0 as rel_pos, event_id % 2 = 0 as fwd from events)
select contig, pos, allele, count(*) as n, cast(sum(qual) as bigint) as qsum, count(*) filter (where fwd) as fwd,
 round(1 - exp(sum(ln(1 - 1 / (1 + exp(-(-9.088E0 + 0.162E0 * qual + 1.645E0 * cast(nqs as int) + 2.349E0 * rel_pos)))))), 6) as p_any from e group by 1, 2, 3""")
def stream_caller(spark, sf):
    """ST1 to ST5: the events table as a stream of several micro-batches, hours as positions; the last one flushes every key."""
    events, out = table(spark, sf, "events"), scratch(spark)
    pos = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = events.select(
        F.col("event_type").alias("contig"), pos.alias("read_start"), pos.alias("pos"), F.substring(F.lit("ACGT"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1)).alias("allele"),
        (F.floor("value") % 41).alias("qual"), (F.col("event_id") % 3 != 0).alias("nqs"), ((F.col("event_id") % 100) / 100.0).alias("rel_pos"), (F.col("event_id") % 2 == 0).alias("fwd"),
    )
    ends = rows.select("contig").distinct().select("contig", *[F.lit(FLUSH).cast(rows.schema[c].dataType).alias(c) if c in ("read_start", "pos") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "contig"])
    cuts = [int(x) for x in rows.approxQuantile("read_start", [0.3, 0.6], 0.05)]
    edges = [None, *sorted(set(cuts)), None]
    parts = [rows.where((F.lit(True) if a is None else F.col("read_start") >= a) & (F.lit(True) if z is None else F.col("read_start") < z)) for a, z in zip(edges, edges[1:])]
    for part in [*parts, ends]:  # the same stream goes on with what has come
        part.write.mode("append").parquet(f"{out}/in")
        stream_alleles(spark.readStream.schema(rows.schema).parquet(f"{out}/in"), out).awaitTermination()
    if not open_sites(spark, out).isEmpty():
        raise ValueError("sites are open after the flush")
    return final_alleles(spark, out).withColumn("p_any", F.round("p_any", 6))
