"""Aligned reads: filters, CIGAR walks and the evidence they give.

A walk is one fold over the CIGAR array inside generated code, which gives every
operation its reference and query offsets; runs then become coverage intervals
without a row per base, and only reads that must differ from the reference
(their NM says so) meet reference tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftbase.config import CallerOptions
from siftbase.functions import scalars as S

KEYS = ["sample_id", "contig"]
READ = ["sample_id", "contig", "qname", "flag", "pos"]
OP = "array<struct<op:string,len:int,r:int,q:int>>"
TILE = 5000


def distinct_reads(reads: DataFrame) -> DataFrame:
    """One row per read; a read that was loaded again counts once, the first loaded stays."""
    rest = [c for c in reads.columns if c not in (*READ, "loaded_at")]
    first = F.min_by(F.struct(*rest), F.coalesce("loaded_at", F.lit("9999-01-01").cast("timestamp"))).alias("_r")
    return reads.groupBy(*READ).agg(first).select(*READ, "_r.*")


def usable(stream: str, o: CallerOptions) -> Column:
    """Mapped, primary, passed, not a duplicate; a CIGAR; mapping quality; an NM."""
    least = max(o.min_snp_mapq, o.min_indel_mapq) if stream == "snp" else o.min_indel_mapq
    return (
        (F.col("flag").bitwiseAND(1796) == 0)
        & (F.size("cigar") > 0)
        & (F.col("mapq") >= least)
        & F.col("nm").isNotNull()
        & (F.col("nm") != -1)
        & F.col("contig").isNotNull()
        & (F.col("pos") >= 0)
    )


def op_sum(*ops: str) -> Column:
    return F.aggregate(F.filter("cigar", lambda x: x["op"].isin(*ops)), F.lit(0), lambda s, x: s + x["len"])


def walk(cigar: Column, pos: Column, on_ref: tuple[str, ...], on_query: tuple[str, ...]) -> Column:
    """Operations with the reference position and the query offset at which each begins."""
    start = F.struct(pos.cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast(OP).alias("ops"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["r"].alias("r"), acc["q"].alias("q"))
        return F.struct(
            (acc["r"] + F.when(x["op"].isin(*on_ref), x["len"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(x["op"].isin(*on_query), x["len"]).otherwise(0)).alias("q"),
            F.concat(acc["ops"], F.array(here)).alias("ops"),
        )

    return F.aggregate(cigar, start, step, lambda acc: acc["ops"])


def tiles(refseq: DataFrame, size: int = TILE) -> DataFrame:
    """Upper-case tiles numbered along their contig, each once."""
    t = refseq.where("contig is not null and tile_start is not null and seq is not null")
    return t.select(F.col("contig").alias("_tc"), F.floor(F.col("tile_start") / size).cast("int").alias("_tile"), F.upper("seq").alias("_tseq")).distinct()


def reference_pieces(df: DataFrame, ref: DataFrame, start: str, length: str, size: int = TILE) -> DataFrame:
    """Rows joined with each tile that [start, start + length) meets: ``_from`` (offset in the row's range) and ``_ref``.

    An equi-join on (contig, tile): Catalyst broadcasts the tiles while they are
    small and shuffles both sides otherwise, and a hot contig spreads over its tiles.
    """
    spread = df.where(F.col(length) > 0).withColumn(
        "_at", F.explode(F.sequence(F.floor(F.col(start) / size).cast("int"), F.floor((F.col(start) + F.col(length) - 1) / size).cast("int")))
    )
    joined = spread.join(ref, (F.col("contig") == F.col("_tc")) & (F.col("_at") == F.col("_tile")))
    a = F.greatest(F.col(start), F.col("_at") * size)
    z = F.least(F.col(start) + F.col(length), (F.col("_at") + 1) * size)
    return joined.withColumn("_from", a - F.col(start)).withColumn("_ref", F.substring("_tseq", a - F.col("_at") * size + 1, z - a)).drop("_tc", "_tile", "_tseq", "_at")


def reference_windows(df: DataFrame, ref: DataFrame, keys: list[str], start: str, length: str, out: str, size: int = TILE) -> DataFrame:
    """``keys`` and the reference text of [start, start + length), cut at the contig's end. ``keys`` are unique."""
    pieces = reference_pieces(df.select(*keys, F.col(start), F.col(length)), ref, start, length, size)
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_from", "_ref"))), lambda x: x["_ref"]), "").alias(out))


def mismatches(seg: Column, ref: Column, base: Column) -> Column:
    """Offsets, from ``base``, at which two texts differ, with both letters."""
    n = F.least(F.length(seg), F.length(ref))
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(seg, i + 1, F.lit(1)) != F.substring(ref, i + 1, F.lit(1)))
    found = F.transform(at, lambda i: F.struct((base + i).alias("i"), F.substring(ref, i + 1, F.lit(1)).alias("ref"), F.substring(seg, i + 1, F.lit(1)).alias("allele")))
    return F.when(n > 0, found).otherwise(F.array().cast("array<struct<i:int,ref:string,allele:string>>"))


def snp_walk(reads: DataFrame, refseq: DataFrame, o: CallerOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, coverage intervals) of the SNP stream from distinct reads.

    Events: sample_id, contig, qname, flag, pos (0-based), ref, allele, qual,
    rel_pos, nqs, fwd. Intervals: sample_id, contig, first, last, rr, dp (weights). Reads whose
    mismatches don't add up to NM keep their coverage and lose their events; so
    do single events without a base quality or with an N.
    """
    o = o or CallerOptions()
    on_ref = ("M", "D", "N", "=", "X") if o.skip_advances_snp else ("M", "D")
    gap, core = op_sum("I", "D"), op_sum("M", "I")
    kept = reads.where(usable("snp", o)).withColumn("l_qseq", F.length("seq"))
    kept = kept.where(op_sum("M", "I", "S") == F.col("l_qseq"))
    kept = kept.withColumn("gap", gap).withColumn("sub", F.col("nm") - F.col("gap"))
    kept = kept.where((F.try_divide("sub", core) <= o.max_sub) & (F.try_divide("gap", core) <= o.max_gap))
    ops = kept.withColumn("o", F.explode(walk(F.col("cigar"), F.col("pos"), on_ref, ("M", "I", "S"))))
    runs = ops.where("o.op in ('M', 'D')").select(
        *KEYS, F.col("o.r").alias("first"), (F.col("o.r") + F.col("o.len") - 1).alias("last"), F.when(F.col("o.op") == "M", 1).otherwise(0).alias("rr"), F.lit(1).alias("dp")
    )
    compared = ops.where("o.op = 'M' and sub <> 0").select(*READ, "qual", "l_qseq", "sub", "o", F.substring("seq", F.col("o.q") + 1, F.col("o.len")).alias("bases"))
    compared = compared.withColumn("_r", F.col("o.r")).withColumn("_n", F.col("o.len"))
    pieces = reference_pieces(compared, tiles(refseq), "_r", "_n")
    seg = F.substring(F.upper("bases"), F.col("_from") + 1, F.length("_ref"))
    pieces = pieces.withColumn("_m", mismatches(seg, F.col("_ref"), F.col("_from")))
    at_q = F.transform("_m", lambda x: F.struct((x["i"] + F.col("o.q")).alias("q"), (x["i"] + F.col("o.r")).alias("pos"), x["ref"].alias("ref"), x["allele"].alias("allele")))
    by_read = pieces.groupBy(*READ, "l_qseq", "sub", "qual").agg(F.flatten(F.collect_list(at_q)).alias("m"))
    less = by_read.select(*KEYS, F.explode("m").alias("m")).select(*KEYS, F.col("m.pos").alias("first"), F.col("m.pos").alias("last"), F.lit(-1).alias("rr"), F.lit(-1).alias("dp"))
    fwd = S.is_forward(F.col("flag"))
    found = by_read.where(F.size("m") == F.col("sub")).select(*KEYS, "qname", "flag", fwd.alias("fwd"), "qual", "l_qseq", F.explode("m").alias("m"))
    d3 = S.distance_3p(F.col("m.q"), F.col("l_qseq"), F.col("fwd"))
    events = found.select(
        *KEYS, "qname", "flag", F.col("m.pos").alias("pos"), F.col("m.ref").alias("ref"), F.col("m.allele").alias("allele"), F.get("qual", F.col("m.q")).alias("event_qual"),
        (d3 / F.col("l_qseq")).alias("rel_pos"), S.nqs_pass(F.col("qual"), F.col("m.q"), d3, F.col("l_qseq")).alias("nqs"), "fwd",
    )
    events = events.withColumnRenamed("event_qual", "qual").where("ref <> 'N' and allele <> 'N' and qual is not null")
    return events, runs.unionByName(less)


def indel_walk(reads: DataFrame, refseq: DataFrame, o: CallerOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, coverage intervals) of the indel stream from distinct reads.

    Events: sample_id, contig, var_start (0-based), del, len, bases, id, fwd,
    mapq, near_end, nbq, var_rate. Intervals: first, last and the weights rr,
    rr_ins, dp. Reference skips count as reference support and advance the
    query; an event without base qualities has a null nbq.
    """
    o = o or CallerOptions()
    on_query = ("M", "=", "X", "N", "I")
    lead = F.when(F.get("cigar", F.lit(0))["op"] == "S", F.get("cigar", F.lit(0))["len"]).otherwise(0)
    tail = F.when(F.element_at("cigar", -1)["op"] == "S", F.element_at("cigar", -1)["len"]).otherwise(0)
    kept = reads.where(usable("indel", o)).withColumn("l_qseq", F.length("seq")).withColumn("lead", lead)
    kept = kept.withColumn("rlen", F.col("l_qseq") - F.col("lead") - F.when(F.size("cigar") > 1, tail).otherwise(0))
    kept = kept.withColumn("ops", walk(F.col("cigar"), F.col("pos"), ("M", "=", "X", "N", "D", "P"), on_query))
    ops = kept.select(*KEYS, F.posexplode("ops").alias("k", "o"))
    r, n, op = F.col("o.r"), F.col("o.len"), F.col("o.op")
    aligned = op.isin("M", "=", "X", "N")
    runs = ops.where(aligned | (op == "D") | ((op == "I") & (F.col("k") == 0))).select(
        *KEYS,
        F.when(op == "I", r - 1).otherwise(r).alias("first"),
        F.when(op == "I", r - 1).otherwise(r + n - 1).alias("last"),
        aligned.cast("int").alias("rr"),
        (op != "D").cast("int").alias("rr_ins"),
        (op != "I").cast("int").alias("dp"),
    )
    varied = kept.where(F.exists("ops", lambda x: x["op"].isin("I", "D")))
    fixed = F.aggregate("ops", F.lit(0), lambda s, x: s + F.when(x["op"] == "X", x["len"]).when(x["op"].isin("I", "D"), 1).otherwise(0))
    matched = varied.select(*READ, "seq", "lead", F.explode(F.filter("ops", lambda x: x["op"] == "M")).alias("o"))
    matched = matched.select(*READ, F.substring(F.upper("seq"), F.col("lead") + F.col("o.q") + 1, F.col("o.len")).alias("bases"), F.col("o.r").alias("_r"), F.col("o.len").alias("_n"))
    pieces = reference_pieces(matched, tiles(refseq), "_r", "_n")
    differ = F.size(mismatches(F.substring("bases", F.col("_from") + 1, F.length("_ref")), F.col("_ref"), F.lit(0)))
    subs = pieces.groupBy(*READ).agg(F.sum(differ).alias("subs"))
    per_read = varied.join(subs, READ, "left").withColumn("var_rate", (F.coalesce("subs", F.lit(0)) + fixed) / F.col("rlen"))
    e = per_read.select(*KEYS, "flag", "mapq", "seq", "qual", "lead", "rlen", "var_rate", F.explode(F.filter("ops", lambda x: x["op"].isin("I", "D"))).alias("o"))
    deletion = F.col("o.op") == "D"
    bases = F.when(deletion, "").otherwise(F.substring(F.upper("seq"), F.col("lead") + F.col("o.q") + 1, F.col("o.len")))
    q, size = F.col("o.q"), F.col("o.len")
    events = e.select(
        *KEYS, F.col("o.r").alias("var_start"), deletion.alias("del"), size.alias("len"), bases.alias("bases"), S.indel_id(deletion, size, bases).alias("id"),
        S.is_forward(F.col("flag")).alias("fwd"), "mapq", S.near_read_end(q, F.col("rlen"), size, deletion, o).alias("near_end"),
        S.neighbourhood_quality(F.col("qual"), F.col("lead"), q, F.col("rlen"), size, deletion).alias("nbq"), "var_rate",
    )
    return events, runs


def mismatch_types(events: DataFrame) -> DataFrame:
    """Adds ``type``: SWAP if a mismatch of the same read one or two bases away has the bases exchanged, MNP beside another mismatch, else SNP."""
    w = Window.partitionBy("sample_id", "contig", "qname", "flag").orderBy("pos")
    near = [(f, k) for f in (F.lag, F.lead) for k in (1, 2)]
    beside, swapped = F.lit(False), F.lit(False)
    for f, k in near:
        gap = F.abs(f("pos", k).over(w) - F.col("pos"))
        beside = beside | F.coalesce(gap == 1, F.lit(False))
        swapped = swapped | F.coalesce((gap <= 2) & (f("ref", k).over(w) == F.col("allele")) & (f("allele", k).over(w) == F.col("ref")), F.lit(False))
    return events.withColumn("type", F.when(swapped, "SWAP").when(beside, "MNP").otherwise("SNP"))
