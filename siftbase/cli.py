"""SRC10: command line. ``python -m siftbase.cli -r ref.fa -b reads.sam -s NAME -p out/prefix``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftbase.config import CallerOptions
from siftbase.operators.joins import with_known
from siftbase.operators.reads import distinct_reads
from siftbase.plans.caller import blocks_of, call, no_variant_rows
from siftbase.session import cut, local_session
from siftbase.sinks.vcf import block_record, header, indel_record, novar_record, snp_record, vcf_lines, verify_text, write_vcf
from siftbase.sources.bam import BamSource, bam_contigs
from siftbase.sources.text import read_bed, read_fasta, read_known_indels, read_sam, read_sam_contigs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftbase")
    p.add_argument("-r", "--ref", required=True, help="reference sequence: FASTA, or parquet with contig, tile_start, seq")
    p.add_argument("-b", "--reads", required=True, help="aligned reads: SAM text, BAM, or parquet")
    p.add_argument("-s", "--sample-name", required=True)
    p.add_argument("-p", "--prefix", required=True, help="output goes to PREFIX_snp.vcf and PREFIX_indel.vcf, folders of part files")
    p.add_argument("-c", "--capture-bed", help="regions to call in; without it every contig is one")
    p.add_argument("--strict-bed", action="store_true", help="exactly three tab-separated fields, taken as they are")
    p.add_argument("--zero-based-bed", action="store_true", help="starts from 0, ends excluded")
    p.add_argument("-S", "--no-scavenge", action="store_true", help="tell equal majorities apart by base quality alone")
    p.add_argument("-a", "--all-non-ref", action="store_true", help="keep every detected variant")
    p.add_argument("--all-indels", action="store_true", help="every indel of a start, not only the one with most reads")
    p.add_argument("--force-reads", type=int, help="keep a site below the threshold with as many variant reads")
    p.add_argument("--force-fraction", type=float, default=0.0, help="... and as large a share of them")
    p.add_argument("--known-indels", help="VCF of known indels, whose frequency goes into INFO")
    p.add_argument("--novar", action="store_true", help="PREFIX_novar: a row for each base without a call")
    p.add_argument("--legacy-indel-target", action="store_true", help="regions don't bound indels")
    p.add_argument("-m", "--min-snp-mapq", type=int, default=1)
    p.add_argument("-n", "--min-indel-mapq", type=int, default=0)
    p.add_argument("-M", "--max-coverage", type=int, default=8000)
    p.add_argument("-x", "--xindel", action="store_true", help="the seven-coefficient indel model")
    p.add_argument("-g", "--gvcf", action="store_true", help="blocks between calls")
    p.add_argument("-A", "--block-abs-lim", type=int, default=3)
    p.add_argument("-R", "--block-rel-lim", type=float, default=0.3)
    p.add_argument("--scf", help="one contig only")
    p.add_argument("--date", default="")
    return p


def read_input(spark: SparkSession, path: str, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads, contigs in the order of the alignment's header); parquet has no header, so its contigs take the order of their names."""
    if path.endswith(".bam"):
        spark.dataSource.register(BamSource)
        reads = spark.read.format("bam").option("path", path).load()
        reads = reads.withColumns({"sample_id": F.lit(0).cast("long"), "loaded_at": F.lit(None).cast("timestamp")})
        return reads, spark.createDataFrame(bam_contigs(path), "contig string, contig_len int, ord int")
    if not path.endswith(".parquet"):
        return read_sam(spark, path), read_sam_contigs(spark, path)
    lengths = ref.groupBy("contig").agg(F.max(F.col("tile_start") + F.length("seq")).cast("int").alias("contig_len"))
    return spark.read.parquet(path), lengths.withColumn("ord", F.row_number().over(Window.orderBy("contig")) - 1)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    o = CallerOptions(
        scavenge=not a.no_scavenge, all_non_ref=a.all_non_ref, min_snp_mapq=a.min_snp_mapq, min_indel_mapq=a.min_indel_mapq, max_coverage=a.max_coverage,
        wgs_indel=a.xindel, gvcf=a.gvcf or a.novar, block_abs=a.block_abs_lim, block_rel=a.block_rel_lim, legacy_indel_target=a.legacy_indel_target,
        force_reads=a.force_reads, force_fraction=a.force_fraction,
    )
    spark = spark or local_session("*")
    ref = spark.read.parquet(a.ref) if a.ref.endswith(".parquet") else read_fasta(spark, a.ref)
    reads, contigs = read_input(spark, a.reads, ref)
    if a.scf:
        reads, ref, contigs = (x.where(F.col("contig") == a.scf) for x in (reads, ref, contigs))
    ref, contigs, reads = cut(ref), cut(contigs), cut(distinct_reads(reads))  # read and made distinct once, used by both streams
    segments = read_bed(spark, a.capture_bed, strict=a.strict_bed, zero_based=a.zero_based_bed) if a.capture_bed else None
    one = None if a.reads.endswith(".parquet") else 0
    c = call(reads, ref, segments, o, one, a.all_indels)
    names = [(r["contig"], r["contig_len"]) for r in contigs.orderBy("ord").collect()]  # as many as a header has lines
    indels = with_known(c.indels, read_known_indels(spark, a.known_indels)) if a.known_indels else c.indels
    for kind, calls, record, surface in (("snp", c.snps, snp_record(), c.snp_surface), ("indel", indels, indel_record(known=bool(a.known_indels)), c.indel_surface)):
        lines = vcf_lines(calls, record, contigs)
        if a.gvcf:
            lines = lines.unionByName(vcf_lines(blocks_of(surface, ref, o), block_record(o, one_based=False), contigs, "block_first", shift=1))
        path = f"{a.prefix}_{kind}.vcf"
        written = write_vcf(lines, header(a.sample_name, names, kind, o, a.date, a.ref, " ".join(argv or []), known=bool(a.known_indels)), path)
        verify_text(spark, path, written)
    if a.novar:
        lines = vcf_lines(no_variant_rows(c.snp_surface, ref), novar_record(), contigs)
        lines.orderBy("ord", "pos", "line").select("line").write.mode("overwrite").text(f"{a.prefix}_novar.vcf")


if __name__ == "__main__":
    main()
