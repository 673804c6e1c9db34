import pytest
from pyspark.sql import functions as F

from siftbase.functions import scalars as S

L = F.lit


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_models(spark):
    got = one(
        spark,
        S.snp_logit(L(40), L(1), L(0.5)), S.snp_logit(L(40), L(1), L(0.9)), S.snp_logit(L(30), L(1), L(0.5)), S.snp_logit(L(30), L(True), L(0.45)),
        S.indel_logit(L(2.0), L(1), L(35), L(10), L(30)), S.indel_logit(L(2.0), L(0), L(35), L(10), L(30)), S.indel_logit(L(1.0), L(1), L(30), L(2), L(30)),
        S.indel_logit_wgs(L(2.0), L(1), L(35), L(60), L(0.02), L(10), L(30)), S.indel_logit_wgs(L(2.0), L(1), L(35), L(60), L(0.10), L(10), L(30)),
        S.indel_logit(L(1.0), L(1), L(30), L(2), L(0)),
    )
    assert got == pytest.approx((0.552679, 0.759712, 0.196471, 0.178587, 0.968055, 0.595207, 0.052909, 0.851174, 0.038454, 1.0), abs=1e-6)


def test_posterior_steps(spark):
    rows = spark.range(10).select(S.posterior(F.col("id").cast("int")).alias("p")).withColumn("q", S.snp_qual(F.col("p"))).collect()
    assert [r["p"] for r in rows] == pytest.approx([9.08173e-07, 0.000224949, 0.000449798, *[0.000899191] * 3, 0.310345, 0.152542, 1, 1], rel=1e-3)
    assert [r["q"] for r in rows] == [0, 0, 0, 0, 0, 0, 2, 1, 59, 60]
    edges = one(spark, *[S.prior_bin(L(x)) for x in (0.0, 0.6, 0.5999999999999999, 0.59999, 0.8999, 1.0)])
    assert edges == (0, 6, 6, 5, 8, 9)


def test_quals_and_genotypes(spark):
    assert one(spark, *[S.indel_qual(L(x)) for x in (0.968055, 0.595207, 0.052909, 1.0, 0.851174)]) == (15, 4, 0, 100, 8)
    assert one(spark, *[S.snp_genotype(L(a), L(d)) for a, d in ((1, 10), (5, 10), (9, 10), (0, 0))]) == ("0/0", "0/1", "1/1", "./.")
    got = one(spark, *[S.indel_genotype(L(n), L(r), L(d)) for n, r, d in ((20, 5, 30), (5, 20, 30), (1, 29, 30), (7, 0, 4), (0, 0, 4), (0, 0, 9))])
    assert got == ("1/1", "1/0", "0/0", "1/.", "./.", "./.")


def test_filters(spark):
    got = one(
        spark,
        S.snp_filters(L(0.31), L(1), L(10), L(1)), S.snp_filters(L(1.0), L(3), L(5), L(1)), S.snp_filters(L(1.0), L(12), L(20), L(12)), S.snp_filters(L(1.0), L(6), L(12), L(3)),
        S.indel_filters(L(0.4), L(1), L(30), L(True), L(0.9)), S.indel_filters(L(0.9), L(9), L(30), L(False), L(0.1)), S.indel_filters(L(0.9), L(3), L(4), L(True), L(0.1)),
    )
    assert got == ("low_snpqual;low_VariantReads;low_VariantRatio", "low_coverage", "single_strand", "PASS", "low_VariantReads;low_VariantRatio;read_end_ratio;low_qual", "PASS", "low_coverage")


def test_entropy(spark):
    def entropy(ref, at, size, deletion):
        start, length = one(spark, *S.entropy_window(L(at), L(size), L(deletion)))
        return one(spark, S.local_entropy(L(ref[start : start + length]), L(size)))[0]

    got = (entropy("A" * 200, 100, 1, True), entropy("A" * 200, 100, 3, False), entropy("AC" * 150, 100, 2, True), entropy("ACGTTGCAAC" * 30, 100, 2, True), entropy("ACGTTGCAAC" * 30, 5, 2, True))
    assert got == pytest.approx((0.046466823, 0.048728630, 0.706606995, 1.975348938, 1.960095135), abs=1e-8)
    assert one(spark, S.local_entropy(L("ACG"), L(5)))[0] == 0.0


def test_read_functions(spark):
    qual = F.array(*[L(30)] * 40)
    low = F.array(*[L(30)] * 8, L(10), *[L(30)] * 31)
    got = one(
        spark,
        S.nqs_pass(qual, L(10), L(29), L(40)), S.nqs_pass(low, L(10), L(29), L(40)), S.nqs_pass(qual, L(4), L(4), L(40)), S.nqs_pass(qual, L(2), L(37), L(40)), S.nqs_pass(qual, L(2), L(7), L(10)),
        S.nqs_pass(F.array().cast("array<int>"), L(10), L(20), L(40)),
    )
    assert got == (True, False, False, True, False, False)
    assert one(spark, S.near_read_end(L(10), L(30), L(2), L(False)), S.near_read_end(L(2), L(30), L(2), L(True)), S.near_read_end(L(24), L(30), L(2), L(False))) == (False, True, True)
    ramp = F.sequence(L(0), L(34))
    assert one(spark, S.neighbourhood_quality(ramp, L(5), L(10), L(30), L(2), L(False)), S.neighbourhood_quality(ramp, L(5), L(20), L(30), L(3), L(True)))[0] == (10 + 20) // 2
    text = one(spark, S.cigar_to_text(S.cigar_from_text(L("5S10M2I8M3D10M"))), F.size(S.phred(L("*"))), S.read_context(L("ACGTACGTACGTA"), L(6), L(True)), S.read_context(L("AACCT"), L(0), L(False)))
    assert text == ("5S10M2I8M3D10M", 0, "acgtacGtacgta", "aggtT")


def test_number_text(spark):
    xs = {0.0: "0", 1.0: "1", 1e-7: "1e-07", 12.5: "12.5", 0.310345: "0.310345", 0.00012345678: "0.000123457", 1234567.0: "1.23457e+06", 0.1525424: "0.152542", 99999.96: "100000"}
    assert one(spark, *[S.significant(L(x), 6) for x in xs]) == tuple(xs.values())
    assert one(spark, S.significant(L(5.5), 5), S.significant(L(0.1 + 0.2), 5)) == ("5.5", "0.3")
