"""Scalar functions as Column expressions; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftbase.config import CallerOptions, ModelParams

M = ModelParams()
O = CallerOptions()  # noqa: E741


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x); large negative x gives 0 without an overflow."""
    return F.when(x < -700.0, 0.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def snp_logit(qual: Column, nqs: Column, rel_pos: Column, swap: Column | None = None, m: ModelParams = M) -> Column:
    """Probability that one read's mismatch is real."""
    x = F.lit(m.snp_intercept) + m.snp_quality * qual + m.snp_nqs * nqs.cast("int") + m.snp_rel_pos * rel_pos
    return logistic(x if swap is None else x + m.snp_swap * swap)


def indel_logit(entropy: Column, strand: Column, nbq: Column, n: Column, depth: Column, m: ModelParams = M) -> Column:
    """Probability of an indel; depth 0 gives 1, as evidence without depth is unbounded."""
    x = F.lit(m.indel_intercept) + m.indel_entropy * entropy + m.indel_strand * strand.cast("int") + m.indel_nbq * nbq
    return F.coalesce(logistic(x + m.indel_norm_var_sq * F.try_divide((n * n).cast("double"), depth)), F.lit(1.0))


def indel_logit_wgs(entropy: Column, strand: Column, nbq: Column, mapq: Column, rate: Column, n: Column, depth: Column, m: ModelParams = M) -> Column:
    """The seven-coefficient model."""
    x = F.lit(m.wgs_intercept) + m.wgs_entropy * entropy + m.wgs_strand * strand.cast("int") + m.wgs_nbq * nbq + m.wgs_mapq * mapq + m.wgs_var_rate * rate
    return F.coalesce(logistic(x + m.wgs_norm_var_sq * F.try_divide((n * n).cast("double"), depth)), F.lit(1.0))


def prior_bin(p_any: Column) -> Column:
    """Tenth of the evidence probability, 0 to 9; guarded against float noise at the edges."""
    return F.least(F.lit(9), F.floor(F.round(10.0 * p_any, 9)).cast("int"))


def posterior(bin_: Column, m: ModelParams = M) -> Column:
    """Posterior of a bin: a step function of ten values."""
    steps = [1.0 / (1.0 + e * m.prior_err / (s * m.prior_snp)) for e, s in zip(m.err_prior, m.snp_prior, strict=True)]
    return F.element_at(F.array(*[F.lit(x) for x in steps]), bin_ + 1)


def snp_qual(p: Column) -> Column:
    return F.round(-10.0 * F.log10(1.0 - p + 1e-6)).cast("int")


def indel_qual(p: Column) -> Column:
    return F.when(1.0 - p < 1e-10, F.lit(100)).otherwise(F.round(-10.0 * F.log10(F.greatest(1.0 - p, F.lit(1e-10)))).cast("int"))


def snp_genotype(vr: Column, dp: Column, o: CallerOptions = O) -> Column:
    ratio = F.try_divide(vr, dp)
    return F.when(dp == 0, "./.").when(ratio <= o.snp_het_min, "0/0").when(ratio < o.snp_het_max, "0/1").otherwise("1/1")


def indel_genotype(n: Column, ref: Column, depth: Column, o: CallerOptions = O) -> Column:
    total = F.when(n == 0, depth).otherwise(n + ref)
    alt, rest = F.coalesce(F.try_divide(n, total), F.lit(0.0)), F.coalesce(F.try_divide(ref, total), F.lit(0.0))
    return (
        F.when(depth < o.indel_min_depth, F.when(n == 0, "./.").otherwise("1/."))
        .when(alt >= o.indel_hom, "1/1").when(alt >= o.indel_het, "1/0")
        .when(rest >= o.indel_hom, "0/0").when(rest >= o.indel_het, "0/.").otherwise("./.")
    )


def labels(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, joined by ``;`` in the given order, or PASS."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))
    return F.when(F.size(names) == 0, "PASS").otherwise(F.array_join(names, ";"))


def snp_filters(p: Column, vr: Column, dp: Column, fwd: Column, o: CallerOptions = O) -> Column:
    share = F.least(fwd, vr - fwd) / vr
    return labels(
        ("low_snpqual", p < o.snp_pass_p),
        ("low_coverage", dp < o.snp_min_coverage),
        ("high_coverage", dp > o.max_coverage),
        ("single_strand", (dp >= o.snp_strand_depth) & (share < o.snp_strand_share)),
        ("low_VariantReads", vr <= o.snp_min_reads),
        ("low_VariantRatio", F.try_divide(vr, dp) <= o.snp_het_min),
    )


def indel_filters(p: Column, n: Column, depth: Column, both_strands: Column, near_end: Column, o: CallerOptions = O) -> Column:
    return labels(
        ("low_VariantReads", n < o.indel_min_reads),
        ("low_coverage", depth < o.indel_min_depth),
        ("high_coverage", depth > o.max_coverage),
        ("low_VariantRatio", F.try_divide(n, depth) < o.indel_min_ratio),
        ("single_strand", F.lit(o.strand_filter) & ~both_strands),
        ("read_end_ratio", near_end > o.max_near_end),
        ("low_qual", p < o.indel_pass_p),
    )


def is_forward(flag: Column) -> Column:
    return flag.bitwiseAND(16) == 0


def distance_3p(q: Column, l_qseq: Column, fwd: Column) -> Column:
    return F.when(fwd, l_qseq - q - 1).otherwise(q)


def nqs_pass(qual: Column, q: Column, d3: Column, l_qseq: Column) -> Column:
    """Neighbourhood quality standard of the base at 0-based ``q``."""
    around = F.slice(qual, F.greatest(q - 4, F.lit(1)), F.lit(11))
    near = (q >= 5) & (l_qseq - q >= 6) & (F.get(qual, q) >= 20) & F.forall(around, lambda x: x >= 15)
    return F.coalesce(F.when(l_qseq <= 10, False).when(d3 > l_qseq - 6, True).otherwise(near), F.lit(False))


def near_read_end(offset: Column, rlen: Column, length: Column, deletion: Column, o: CallerOptions = O) -> Column:
    end = F.when(deletion, offset).otherwise(offset + length)
    return (offset + 1 <= o.near_end) | (rlen - end < o.near_end + 2)


def neighbourhood_quality(qual: Column, lead: Column, offset: Column, rlen: Column, length: Column, deletion: Column) -> Column:
    """Integer mean of the base qualities around an indel, clips left out; null without qualities."""
    end = F.when(deletion, offset).otherwise(offset + length)
    a, z = F.greatest(F.lit(0), offset - 5), F.least(rlen - 1, end + 3)
    n = F.greatest(z - a + 1, F.lit(0))
    total = F.aggregate(F.slice(qual, lead + a + 1, n), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(qual) >= lead + z + 1) & (n > 0), F.floor(total / n).cast("int"))


def entropy_window(var_start: Column, length: Column, deletion: Column) -> tuple[Column, Column]:
    """0-based start and length of the reference window of local_entropy."""
    start = F.greatest(F.lit(0), F.when(deletion, var_start - 10).otherwise(var_start - 11))
    start = F.when(var_start <= 10, 0).otherwise(start)
    end = F.when(deletion, var_start + length + 10).otherwise(var_start + 11)
    return start, end - start


def local_entropy(window: Column, length: Column) -> Column:
    """Entropy of the window's k-mers of the indel's length, over their number plus one."""
    n = F.length(window) - length
    kmers = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(window, i, length))
    shares = F.transform(F.array_distinct(kmers), lambda k: F.size(F.filter(kmers, lambda x: x == k)) / (n + 1))
    return F.when(n > 0, -F.aggregate(shares, F.lit(0.0), lambda s, f: s + f * F.ln(f))).otherwise(0.0)


def indel_id(deletion: Column, length: Column, bases: Column) -> Column:
    return F.when(deletion, length.cast("string")).otherwise(bases)


def region_text(contig: Column, first: Column, second: Column) -> Column:
    """1-based region of a 0-based interval, both ends included."""
    return F.concat(contig, F.lit(":"), first + 1, F.lit("-"), second + 1)


def cigar_from_text(text: Column) -> Column:
    """``5S10M`` as an array of (op, len)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(
        parts, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"))
    )


def cigar_to_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def phred(text: Column) -> Column:
    """SAM quality text as numbers; ``*`` and null are empty."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    return F.when(text.isNull() | (text == "*"), F.array().cast("array<int>")).otherwise(F.transform(letters, lambda x: F.ascii(x) - 33))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def read_context(seq: Column, q: Column, fwd: Column, around: int = 6) -> Column:
    """Bases around 0-based ``q``, the middle in upper case, reverse-complemented on the reverse strand."""
    left = F.lower(F.substring(seq, F.greatest(q + 1 - around, F.lit(1)), F.least(q, F.lit(around))))
    text = F.concat(left, F.upper(F.substring(seq, q + 1, F.lit(1))), F.lower(F.substring(seq, q + 2, F.lit(around))))
    return F.when(fwd, text).otherwise(F.reverse(complement(text)))


def significant(x: Column, digits: int) -> Column:
    """A number as C++ streams print it: ``digits`` significant, no trailing zeros."""
    size = F.floor(F.log10(F.abs(x))).cast("int")
    rounded = F.bround(x * F.pow(F.lit(10.0), (digits - 1 - size).cast("double"))) / F.pow(F.lit(10.0), (digits - 1 - size).cast("double"))
    size = F.floor(F.log10(F.abs(rounded))).cast("int")
    text = F.format_string(f"%.{digits + 8}f", rounded)
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exact = F.format_string(f"%.{digits - 1}e", x)
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(exact, r"^([^e]+)e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.regexp_extract(exact, r"e(.+)$", 1))
    return F.when(x == 0, "0").when((size < -4) | (size >= digits), scientific).otherwise(plain)
