"""VCF text of calls and blocks, and writers that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbase.config import CallerOptions
from siftbase.functions.scalars import significant
from siftbase.session import cut


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def header(sample: str, contigs: list[tuple[str, int]], kind: str = "snp", o: CallerOptions | None = None, date: str = "", reference: str = "", command: str = "", known: bool = False) -> str:
    """SNK2: the header lines of a ``kind`` ('snp' or 'indel') file; date and command are given, so that output is repeatable."""
    o = o or CallerOptions()
    number = lambda x: f"{x:g}"
    out = ["##fileformat=VCFv4.1", f"##fileDate={date}", "##source=siftbase", f"##reference={reference}", f"##command={command}"]
    for name, what, text in (("GT", "String", "Called genotype"), ("GQ", "Integer", "Quality of the genotype"), ("DP", "Integer", "Reads at the site"), ("RR", "Integer", "Reads with the reference"), ("VR", "Integer", "Reads with the called variant")):
        out.append(f'##FORMAT=<ID={name},Number=1,Type={what},Description="{text}">')
    snp = kind == "snp"
    filters = [
        ("low_snpqual" if snp else "low_qual", f"Posterior below {number(o.snp_pass_p if snp else o.indel_pass_p)}"),
        ("low_VariantReads", f"Variant reads {'not above' if snp else 'below'} {o.snp_min_reads if snp else o.indel_min_reads}"),
        ("low_VariantRatio", f"Share of variant reads {'not above' if snp else 'below'} {number(o.snp_het_min if snp else o.indel_min_ratio)}"),
        ("low_coverage", f"Depth below {o.snp_min_coverage if snp else o.indel_min_depth}"),
    ]
    if snp:
        filters += [("high_coverage", f"Depth above {o.max_coverage}"), ("single_strand", "Variant reads come from one strand")]
    else:
        filters += [("read_end_ratio", f"Share of variant reads near a read end above {number(o.max_near_end)}")]
    filters += [("No_data", "No usable reads"), ("No_var", "No usable variant reads")]
    out += [f'##FILTER=<ID={a},Description="{b}">' for a, b in filters]
    out.append(f'##INFO=<ID=P,Number=1,Type=Float,Description="Posterior of the {kind}">')
    if snp:
        out.append('##INFO=<ID=equal_majority,Number=0,Type=Flag,Description="Another base has as many reads">')
    if known:
        out.append('##INFO=<ID=AF,Number=1,Type=Float,Description="Frequency of the known indel">')
    if o.gvcf:
        out += [f'##INFO=<ID={c}X,Number=4,Type=Float,Description="Minimum, maximum, mean and standard deviation of {c} in the block">' for c in ("P", "DP", "RR", "VR")]
        out += ['##INFO=<ID=breakblock,Number=1,Type=String,Description="What ended the block">', f'##INFO=<ID=BLOCKAVG_{o.block_label},Number=0,Type=Flag,Description="Tolerance of the blocks">', '##INFO=<ID=END,Number=1,Type=Integer,Description="Last position of the block">']
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    return "\n".join([*out, f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}"]) + "\n"


def _record(pos: Column, ref: Column, alt: Column, qual: Column, filters: Column, info: Column, gt: Column, vr: Column, rr: Column, dp: Column) -> Column:
    sample = F.concat_ws(":", gt, _text(vr), _text(rr), _text(dp), F.lit("."))
    return F.concat_ws("\t", "contig", _text(pos), F.lit("."), ref, alt, qual, filters, info, F.lit("GT:VR:RR:DP:GQ"), sample)


def snp_record() -> Column:
    """SNK5: line of a row of call_snps."""
    info = F.concat(F.lit("P="), significant(F.col("p"), 6), F.when(F.col("equal_majority"), ";equal_majority").otherwise(""))
    return _record(F.col("pos"), F.col("ref"), F.col("alt"), _text("qual"), F.col("filters"), info, F.col("gt"), F.col("vr"), F.col("rr"), F.col("dp"))


def indel_record(known: bool = False) -> Column:
    """SNK6: line of a row of call_indels; ``known`` adds the frequency ``af`` of a known indel."""
    info = F.concat(F.lit("P="), significant(F.col("p"), 5))
    if known:
        info = F.concat(info, F.when(F.col("af").isNotNull(), F.concat(F.lit(";AF="), significant(F.col("af"), 5))).otherwise(""))
    return _record(F.col("pos"), F.col("ref"), F.col("alt"), _text("qual"), F.col("filters"), info, F.col("gt"), F.col("vr"), F.col("rr"), F.col("dp"))


def novar_record() -> Column:
    """SNK8: line of a row of no_variant_rows; the quality is the site's probability."""
    return _record(F.col("pos"), F.col("ref"), F.lit("."), significant(F.col("p"), 5), F.col("filters"), F.lit("."), F.lit("."), F.col("vr"), F.col("rr"), F.col("dp"))


def block_record(o: CallerOptions | None = None, one_based: bool = True, with_p: bool = False) -> Column:
    """SNK7: line of a row of nonvariant_blocks that has ``ref``, the base at the block's start.

    PX is 0 inside regions, as a probability is kept only where a site lies off target; ``with_p`` takes the statistics of ``p``.
    """
    o = o or CallerOptions()
    shift = 0 if one_based else 1
    four = lambda c: F.concat_ws(",", *[significant(F.col(f"{c}_{x}").cast("double"), 5) for x in ("min", "max", "mean", "sd")])
    info = F.concat(
        F.lit("END="), _text(F.col("block_last") + shift), F.lit(f";BLOCKAVG_{o.block_label};PX="), four("p") if with_p else F.lit("0,0,0,0"), F.lit(";VRX="), four("vr"), F.lit(";RRX="), four("rr"), F.lit(";DPX="), four("dp"), F.lit(";breakblock="), "reason"
    )
    return _record(F.col("block_first") + shift, F.col("ref"), F.lit("."), F.lit("."), F.lit("PASS"), info, F.lit("0/0"), F.col("vr_min"), F.col("rr_min"), F.col("dp_min"))


def vcf_lines(calls: DataFrame, record: Column, contigs: DataFrame, pos: str = "pos", shift: int = 0) -> DataFrame:
    """``ord``, ``pos``, ``line``: records with the place of their contig in the header; contigs missing there come last. ``shift`` makes ``pos`` 1-based."""
    rows = calls.withColumn("line", record).join(contigs.select("contig", "ord"), "contig", "left")
    return rows.select(F.coalesce("ord", F.lit(2**31 - 1)).alias("ord"), (F.col(pos) + shift).cast("long").alias("pos"), "line")


def write_vcf(lines: DataFrame, head: str, path: str) -> int:
    """SNK3, O2, O3: header and records in header order; the part files in the order of their names are the file.

    Records are range-partitioned and sorted where they fall; no task gets all.
    Returns how many records were written.
    """
    spark = lines.sparkSession
    lines = cut(lines)
    top = spark.createDataFrame([(-1, i, x) for i, x in enumerate(head.rstrip("\n").split("\n"))], "ord int, pos long, line string")
    rows = top.unionByName(lines.select(F.col("ord").cast("int").alias("ord"), "pos", "line"))
    rows.orderBy("ord", "pos", "line").select("line").write.mode("overwrite").text(path)
    return lines.count()


def write_by_contig(calls: DataFrame, path: str, force: bool = False, rows_a_file: int = 5_000_000) -> list[str]:
    """SNK1, SNK11: one folder per contig; contigs written before are skipped unless ``force``. Returns what was skipped.

    A contig counts as written once its mark is there, which is made after the
    write has been committed; what a failed write left is written over. Rows are
    range-partitioned by contig and position, so a large contig is many tasks
    and files of at most ``rows_a_file`` rows.
    """
    spark = calls.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    if not force and fs.exists(to(f"{path}/_done")):
        done = [s.getPath().getName().removeprefix("contig=") for s in fs.listStatus(to(f"{path}/_done"))]
    todo = calls.where(~F.col("contig").isin(done)) if done else calls
    todo = cut(todo)
    names = [r["contig"] for r in todo.select("contig").distinct().collect()]  # as many as a header has lines
    rows = todo.repartitionByRange("contig", *[c for c in ("pos",) if c in calls.columns]).write.option("maxRecordsPerFile", rows_a_file)
    rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("contig").parquet(path)
    for name in names:
        fs.create(to(f"{path}/_done/contig={name}"), True).close()
    return sorted(done)


def verify_text(spark, path: str, expected: int) -> None:
    """SNK10: raises where written text has another number of records than expected, or a NUL."""
    text = spark.read.text(path)
    n, bad = text.agg(F.count_if(~F.col("value").startswith("#")), F.count_if(F.contains("value", F.lit("\x00")))).first()
    if bad or n != expected:
        raise ValueError(f"{path}: {n} records of {expected}, {bad} lines with NUL")
