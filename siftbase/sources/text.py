"""Text sources: SAM, FASTA, BED and known-indel VCF, parsed by Spark expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbase.functions.scalars import cigar_from_text, phred
from siftbase.operators.carry import running
from siftbase.operators.joins import known_key


def read_sam(spark: SparkSession, path: str, sample_id: int = 0) -> DataFrame:
    """SRC1, SRC3: alignments of SAM text as aligned_reads rows; positions become 0-based, a missing NM stays null."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length(F.trim("value")) > 0))
    f = F.split("value", "\t")
    text = lambda i: F.get(f, F.lit(i))
    nm = F.nullif(F.regexp_extract("value", r"\tNM:i:(-?\d+)", 1), F.lit(""))
    return lines.select(
        text(0).alias("qname"), F.lit(sample_id).cast("long").alias("sample_id"), text(1).cast("int").alias("flag"), text(2).alias("contig"), (text(3).cast("int") - 1).alias("pos"),
        text(4).cast("int").alias("mapq"), F.when(text(5) == "*", F.array().cast("array<struct<op:string,len:int>>")).otherwise(cigar_from_text(text(5))).alias("cigar"),
        F.when(text(9) == "*", "").otherwise(text(9)).alias("seq"), phred(text(10)).alias("qual"), nm.cast("int").alias("nm"), F.lit(None).cast("timestamp").alias("loaded_at"),
    )


def read_sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: names and lengths of a SAM header with their order in the file."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    rows = lines.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("contig_len"), F.monotonically_increasing_id().alias("_at"))
    from pyspark.sql import Window

    return rows.select("contig", "contig_len", (F.row_number().over(Window.orderBy("_at")) - 1).alias("ord"))


def read_fasta(spark: SparkSession, path: str, tile: int = 5000) -> DataFrame:
    """SRC5: contig, tile_start, seq in tiles.

    Lines are read in splits of the file, so a contig is never one row: the bases
    before a line and the header it stands under are running aggregates over
    (file, split), carried from split to split, and lines meet again by tile.
    Lines before the first header and contigs without bases are left out; a
    contig that comes twice gives its tiles twice.
    """
    base = F.when(F.startswith("value", F.lit(">")), F.lit("")).otherwise(F.regexp_replace("value", r"\s", ""))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
        base.alias("_s"), F.when(F.startswith("value", F.lit(">")), F.regexp_extract("value", r"^>(\S+)", 1)).alias("_name"),
    )
    rows = running(lines, ["_file"], [F.col("_at")], F.length("_s").cast("long"), "_from", "sum", bin_col="_block", inclusive=False)
    head = F.when(F.col("_name").isNotNull(), F.struct("_block", "_at", "_from", "_name"))
    rows = running(rows, ["_file"], [F.col("_at")], head, "_head", "max", bin_col="_block")
    rows = rows.where(F.length("_s") > 0).where(F.col("_head").isNotNull()).withColumn("_from", F.col("_from") - F.col("_head._from"))
    no = F.explode(F.sequence(F.floor(F.col("_from") / tile), F.floor((F.col("_from") + F.length("_s") - 1) / tile)))
    cut = rows.withColumn("_no", no).withColumn("tile_start", (F.col("_no") * tile).cast("int"))
    skip = F.greatest(F.col("tile_start") - F.col("_from"), F.lit(0)).cast("int")
    upto = (F.col("tile_start") + F.lit(tile) - F.col("_from")).cast("int")
    piece = F.struct("_from", F.substring("_s", skip + 1, upto - skip).alias("s"))
    met = cut.groupBy("_file", "_head", "tile_start").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    return met.select(F.col("_head._name").alias("contig"), "tile_start", F.array_join("_pieces.s", "").alias("seq"))


def parse_bed(lines: DataFrame, column: str = "value", strict: bool = False, zero_based: bool = False) -> DataFrame:
    """SRC6, SRC7: adds contig, seg_first, seg_second (0-based, both ends included); short, comment and unreadable lines are left out.

    ``strict`` takes exactly three tab-separated fields and no shift, and raises on any other line; ``zero_based`` takes starts as they are and ends as excluded.
    """
    text = F.trim(column)
    if strict:
        f = F.split(column, "\t")
        ok = F.assert_true(F.size(f) == 3, F.concat(F.lit("not three fields: "), F.col(column)))
        rows = lines.where(ok.isNull())
        return rows.select(*lines.columns, f[0].alias("contig"), f[1].cast("int").alias("seg_first"), f[2].cast("int").alias("seg_second"))
    f = F.split(text, r"\s+")
    rows = lines.where((F.size(f) >= 3) & ~text.startswith("#") & F.get(f, F.lit(1)).rlike(r"^\d+$") & F.get(f, F.lit(2)).rlike(r"^\d+$"))
    shift = 0 if zero_based else 1
    return rows.select(*lines.columns, f[0].alias("contig"), (f[1].cast("int") - shift).alias("seg_first"), (f[2].cast("int") - 1).alias("seg_second"))


def read_bed(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    return parse_bed(spark.read.text(path), **options).drop("value")


def known_indels(rows: DataFrame) -> DataFrame:
    """SRC9, D16: adds ``key`` and ``af`` (GMAF of the info, else 0.0001) to rows of contig, pos, ref_allele, alt_allele, info; several alternatives are left out."""
    gmaf = F.regexp_extract(F.coalesce("info", F.lit("")), r"(?:^|;)GMAF=([0-9.eE+-]+)", 1)
    single = rows.where("contig is not null and pos is not null and ref_allele is not null and alt_allele is not null").where(~F.contains("alt_allele", F.lit(",")) & (F.length("ref_allele") != F.length("alt_allele")))
    return single.withColumn("key", known_key(F.col("pos"), F.col("ref_allele"), F.col("alt_allele"))).withColumn("af", F.coalesce(gmaf.try_cast("double"), F.lit(0.0001)))


def read_known_indels(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = lines.select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("int").alias("pos"), F.get(f, F.lit(3)).alias("ref_allele"), F.get(f, F.lit(4)).alias("alt_allele"), F.get(f, F.lit(7)).alias("info"))
    return known_indels(rows)
