import struct
import zlib

import pytest
from pyspark.sql import functions as F

from siftbase import cli
from siftbase.config import CallerOptions
from siftbase.functions.scalars import cigar_to_text
from siftbase.operators.calls import allele_counts, call_indels, call_snps, majority, merge_indels, top_indels
from siftbase.operators.reads import distinct_reads, indel_walk, mismatch_types, snp_walk
from siftbase.sinks.vcf import block_record, header, indel_record, snp_record, vcf_lines, verify_text, write_by_contig, write_vcf
from siftbase.sources.bam import BamSource
from siftbase.sources.text import read_bed, read_fasta, read_known_indels, read_sam, read_sam_contigs, parse_bed
from siftbase.streaming.caller import FLUSH, final_alleles, open_sites, stream_alleles

R = "ACGTTGCAAC" * 30
READ = "qname string, sample_id long, flag int, contig string, pos int, mapq int, cigar array<struct<op:string,len:int>>, seq string, qual array<int>, nm int, loaded_at timestamp"


def ops(text):
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append((c, int(n)))
            n = ""
    return out


def read(name, pos, cigar, seq, nm, flag=0, mapq=60, qual=30, contig="c"):
    return (name, 1, flag, contig, pos, mapq, ops(cigar), seq, [qual] * len(seq) if isinstance(qual, int) else qual, nm, None)


def reads(spark, *rows):
    return spark.createDataFrame(list(rows), READ)


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame([("c", 0, R), ("c", 0, R)], "contig string, tile_start int, seq string")


def test_snp_walk(spark, ref):
    seq = R[20:30] + "G" + R[31:40]
    events, cover = snp_walk(distinct_reads(reads(spark, read("a", 20, "20M", seq, 1), read("a", 20, "20M", seq, 1))), ref)
    e = events.collect()
    assert [(r["pos"], r["ref"], r["allele"], r["qual"], r["rel_pos"], r["nqs"]) for r in e] == [(30, "A", "G", 30, 0.45, True)]
    depth = {}
    for r in cover.collect():
        for p in range(r["first"], r["last"] + 1):
            depth[p] = depth.get(p, 0) + r["dp"]
    assert {p for p, d in depth.items() if d} == {*range(20, 30), *range(31, 40)}


def test_reads_left_out(spark, ref):
    s = R[20:30] + "G" + R[31:40]
    bad = [read("a", 20, "20M", s, 1, flag=f) for f in (4, 256, 512, 1024)] + [read("b", 20, "20M", s, None), read("c", 20, "20M", s, -1), read("d", 20, "", s, 1), read("e", -1, "20M", s, 1, contig="*"), read("f", 20, "20M", s, 1, mapq=0), read("g", 20, "20=", s, 1)]
    events, cover = snp_walk(distinct_reads(reads(spark, *bad)), ref)
    assert events.count() == 0 and cover.count() == 0
    # mismatches that don't add up to NM: events go, coverage stays; no qualities: likewise; supplementary reads count
    odd = [read("a", 20, "20M", R[20:30] + "GA" + R[32:40], 1), read("b", 20, "20M", s, 1, qual=[]), read("s", 20, "20M", R[20:40], 0, flag=2048)]
    events, cover = snp_walk(distinct_reads(reads(spark, *odd)), ref)
    assert events.count() == 0 and cover.where("dp > 0").count() == 3


def test_indel_walk(spark, ref):
    seq = "AAAAA" + R[100:110] + "TT" + R[110:118] + R[121:131]
    rows = distinct_reads(reads(spark, read("a", 100, "5S10M2I8M3D10M", seq, 5)))
    events, cover = indel_walk(rows, ref)
    e = {r["id"]: r for r in events.collect()}
    assert {k: (r["var_start"], r["len"], r["near_end"], r["nbq"]) for k, r in e.items()} == {"TT": (110, 2, False, 30), "3": (118, 3, False, 30)}
    assert e["TT"]["var_rate"] == pytest.approx(2 / 30)
    rr, dp = set(), set()
    for r in cover.collect():
        span = set(range(r["first"], r["last"] + 1))
        rr |= span if r["rr"] else set()
        dp |= span if r["dp"] else set()
    assert rr == {*range(100, 118), *range(121, 131)} and dp == set(range(100, 131))
    assert snp_walk(rows, ref)[0].count() == 0
    o = CallerOptions(all_non_ref=True)
    calls = {(r["pos"], r["ref"], r["alt"]) for r in call_indels(rows, ref, o).collect()}
    assert calls == {(110, R[109], R[109] + "TT"), (118, R[117:121], R[117])}
    assert call_indels(rows.limit(0), ref).count() == 0


def test_majority_and_ties(spark):
    def pick(rows, by):
        df = spark.createDataFrame([(1, "A", a, n, q, 0, 0.7, p) for a, n, q, p in rows], "pos int, ref string, allele string, n int, qsum long, fwd int, p_any double, p double")
        r = majority(df, ["pos", "ref"], by).first()
        return r["allele"], r["ties"], r["all_reads"]

    assert pick([("A", 2, 40, 0.1), ("C", 2, 40, 0.1)], "quality") == ("A", 2, 4)
    assert pick([("A", 2, 40, 0.1), ("C", 2, 60, 0.1), ("G", 2, 50, 0.1)], "quality") == ("G", 3, 6)
    assert pick([("A", 1, 40, 0.1), ("C", 1, 60, 0.9)], "posterior") == ("A", 1, 2)
    assert pick([("A", 2, 40, 0.1), ("C", 2, 60, 0.9), ("G", 1, 99, 1.0)], "posterior") == ("C", 2, 5)


def test_top_indel(spark):
    rows = [("1", True, 1, "")] * 3 + [("12", True, 12, "")] * 3 + [("AC", False, 2, "AC")] * 3
    df = spark.createDataFrame([(1, "c", 50, i, d, n, b, True, 60, False, 30, 0.1) for i, d, n, b in rows], "sample_id long, contig string, var_start int, id string, del boolean, len int, bases string, fwd boolean, mapq int, near_end boolean, nbq int, var_rate double")
    r = top_indels(merge_indels(df)).first()
    assert (r["id"], r["n"], r["all_reads"]) == ("1", 3, 9)


def test_mismatch_types(spark):
    rows = [(1, "c", "r", 0, p, a, b) for p, a, b in ((5, "A", "C"), (6, "C", "A"), (20, "A", "G"), (21, "A", "T"), (40, "A", "G"), (50, "A", "C"), (52, "C", "A"))]
    df = spark.createDataFrame(rows, "sample_id long, contig string, qname string, flag int, pos int, ref string, allele string")
    got = {r["pos"]: r["type"] for r in mismatch_types(df).collect()}
    assert got == {5: "SWAP", 6: "SWAP", 20: "MNP", 21: "MNP", 40: "SNP", 50: "SWAP", 52: "SWAP"}


def snp_reads():
    bases = lambda i: R[60:75] + "T" + R[76:90]
    return [read(f"r{i}", 60, "30M", bases(i) if i < 6 else R[60:90], 1 if i < 6 else 0, flag=16 * (i % 2), qual=38) for i in range(12)]


def test_snp_call_and_text(spark, ref, tmp_path):
    rows = distinct_reads(reads(spark, *snp_reads()))
    calls = call_snps(rows, ref)
    r = calls.first()
    assert (r["pos"], r["ref"], r["alt"], r["gt"], r["vr"], r["rr"], r["dp"], r["filters"], r["qual"]) == (76, R[75], "T", "0/1", 6, 6, 12, "PASS", 60)
    contigs = spark.createDataFrame([("c", 300, 0)], "contig string, contig_len int, ord int")
    lines = vcf_lines(calls, snp_record(), contigs)
    head = header("s1", [("c", 300)], date="20250101", o=CallerOptions(gvcf=True))
    write_vcf(lines, head, str(tmp_path / "v"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*")))
    assert text.startswith("##fileformat=VCFv4.1\n") and "BLOCKAVG_min30p3a" in head
    assert text.rstrip("\n").split("\n")[-1].split("\t")[:7] == ["c", "76", ".", R[75], "T", "60", "PASS"]
    assert text.rstrip("\n").endswith("GT:VR:RR:DP:GQ\t0/1:6:6:12:.")
    verify_text(spark, str(tmp_path / "v"), 1)
    with pytest.raises(ValueError):
        verify_text(spark, str(tmp_path / "v"), 2)
    assert write_by_contig(calls, str(tmp_path / "w")) == [] and write_by_contig(calls, str(tmp_path / "w")) == ["c"]
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1
    assert call_indels(rows, ref).select(indel_record()).count() == 0
    block = spark.createDataFrame([("c", 3, 9, "dp", "A", *[1, 2, 1.5, 0.5] * 3)], "contig string, block_first int, block_last int, reason string, ref string, " + ", ".join(f"{c}_min long, {c}_max long, {c}_mean double, {c}_sd double" for c in ("dp", "rr", "vr")))
    assert block.select(block_record()).first()[0].split("\t")[7] == "END=9;BLOCKAVG_min30p3a;PX=0,0,0,0;VRX=1,2,1.5,0.5;RRX=1,2,1.5,0.5;DPX=1,2,1.5,0.5;breakblock=dp"


def test_partitions_and_order_do_not_matter(spark, ref):
    rows = snp_reads()
    one = sorted(map(tuple, call_snps(distinct_reads(reads(spark, *rows)), ref).collect()))
    two = sorted(map(tuple, call_snps(distinct_reads(reads(spark, *rows[::-1]).repartition(7)), ref).collect()))
    assert one == two and len(one) == 1


def test_text_sources(spark, tmp_path):
    seq = R[20:30] + "G" + R[31:40]
    (tmp_path / "a.sam").write_text(f"@HD\tVN:1.6\n@SQ\tSN:c\tLN:300\n@SQ\tSN:d\tLN:9\nr1\t16\tc\t21\t60\t5S10M2I8M\t*\t0\t0\t{seq}\t{'?' * 20}\tXX:Z:a\tNM:i:3\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    got = read_sam(spark, str(tmp_path / "a.sam"), 7).withColumn("text", cigar_to_text(F.col("cigar"))).collect()
    assert [(r["qname"], r["flag"], r["contig"], r["pos"], r["text"], r["seq"], len(r["qual"]), r["nm"]) for r in got] == [("r1", 16, "c", 20, "5S10M2I8M", seq, 20, 3), ("r2", 4, "*", -1, "", "", 0, None)]
    assert got[0]["qual"] == [30] * 20
    assert [tuple(r) for r in read_sam_contigs(spark, str(tmp_path / "a.sam")).collect()] == [("c", 300, 0), ("d", 9, 1)]
    (tmp_path / "r.fa").write_text(">c one\nACGT\nACG\n>d\nTT\n")
    assert sorted(tuple(r) for r in read_fasta(spark, str(tmp_path / "r.fa"), 3).collect()) == [("c", 0, "ACG"), ("c", 3, "TAC"), ("c", 6, "G"), ("d", 0, "TT")]
    (tmp_path / "t.bed").write_text("chrT 101 200\nshort 5\n# a comment line\nx\t7  9 name\n")
    assert [tuple(r) for r in read_bed(spark, str(tmp_path / "t.bed")).collect()] == [("chrT", 100, 199), ("x", 6, 8)]
    assert [tuple(r)[1:] for r in parse_bed(spark.createDataFrame([("a\t5\t9",)], "value string"), strict=True).collect()] == [("a", 5, 9)]
    with pytest.raises(Exception, match="not three fields"):
        parse_bed(spark.createDataFrame([("a 5 9",)], "value string"), strict=True).collect()
    (tmp_path / "k.vcf").write_text("##x\nc\t5\t.\tACG\tA\t.\t.\tRS=1;GMAF=0.25\nc\t6\t.\tA\tAT\t.\t.\t.\nc\t7\t.\tA\tAT,AC\t.\t.\tGMAF=0.1\n")
    assert [(r["key"], r["af"]) for r in read_known_indels(spark, str(tmp_path / "k.vcf")).collect()] == [("5D2", 0.25), ("6IT", 0.0001)]


def bgzf(data):
    out = b""
    for i in range(0, len(data), 60):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data[i : i + 60]) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[i : i + 60]), len(data[i : i + 60]))
    return out


def bam_record(name, pos, cigar, seq, qual, tags=b"", flag=0):
    packed = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for o, n in cigar) + bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2])) + bytes(qual) + tags
    return struct.pack("<i", len(body)) + body


def test_bam_source(spark, tmp_path):
    data = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 300)
    data += bam_record("r1", 20, ops("20M"), R[20:40], [30] * 20, b"XXZabc\0NMC\x01") + bam_record("r2", 200, ops("5M2D"), "ACGTN", [255] * 5, b"BBBs\x02\0\0\0\x01\0\x02\0NMi\x07\0\0\0") + bam_record("r3", 90, [], "", [])
    (tmp_path / "a.bam").write_bytes(bgzf(data))
    spark.dataSource.register(BamSource)
    load = lambda **o: {r["qname"]: r for r in spark.read.format("bam").option("path", str(tmp_path / "*.bam")).options(**o).load().collect()}
    got = load()
    assert got["r1"]["seq"] == R[20:40] and got["r1"]["nm"] == 1 and got["r1"]["qual"] == [30] * 20 and got["r1"]["contig"] == "c"
    assert got["r2"]["nm"] == 7 and got["r2"]["qual"] == [] and got["r2"]["seq"] == "ACGTN" and got["r3"]["nm"] is None
    assert set(load(contig="c", first=39, last=89)) == {"r1"} and set(load(contig="c", first=206, last=206)) == {"r2"}
    (tmp_path / "b.bam").write_bytes(b"nothing")
    with pytest.raises(Exception, match="BGZF"):
        load()


def test_fasta_is_split_without_loss(spark, tmp_path):
    want = {f"c{i}": ("ACGTNacgtn" * (n // 10 + 1))[:n] for i, n in enumerate([0, 1, 59, 60, 61, 5000, 12345])}
    text = "before any header\n"
    for i, (c, s) in enumerate(want.items()):
        width, end = (7, 60, 9000)[i % 3], ("\n", "\r\n")[i % 2]
        text += f">{c} more > words\n" + "".join(s[k : k + width] + end for k in range(0, len(s), width)) + "\n"
    (tmp_path / "r.fa").write_text(text)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path / "r.fa")).rdd.getNumPartitions() > 3
        rows = sorted(tuple(r) for r in read_fasta(spark, str(tmp_path / "r.fa"), 1000).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    got = {}
    for contig, start, seq in rows:
        assert start == len(got.get(contig, "")) and 0 < len(seq) <= 1000
        got[contig] = got.get(contig, "") + seq
    assert got == {c: s for c, s in want.items() if s}


def test_bam_is_split_without_loss(spark, tmp_path):
    data = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 40)
    data += b"".join(struct.pack("<i", 5) + b"c%03d\0" % i + struct.pack("<i", 300) for i in range(40))  # a header over several parts
    reads = [(f"r{i}", i * 7 % 280, (i * 37) % 20 if i % 50 else 900) for i in range(400)]  # some over many blocks
    data += b"".join(bam_record(n, p, [("M", k)] if k else [], (R * 4)[:k], [i % 41 for i in range(k)], b"NMC\x00" * (p % 2)) for n, p, k in reads)
    (tmp_path / "s.bam").write_bytes(bgzf(data))
    spark.dataSource.register(BamSource)
    for split in (0, 97, 1000, 5000):
        df = spark.read.format("bam").option("path", str(tmp_path / "s.bam")).option("split_bytes", split).load()
        if split == 97:  # every part, without a task for each
            reader = BamSource({"path": str(tmp_path / "s.bam"), "split_bytes": "97"}).reader(None)
            got = [(r[0], r[3], len(r[6])) for part in reader.partitions() for r in reader._records(part)]
        else:
            got = [(r["qname"], r["pos"], len(r["seq"])) for r in df.collect()]
            assert df.rdd.getNumPartitions() == (1 if split == 0 else -(-len(bgzf(data)) // split))
        assert sorted(got) == sorted(reads)


def test_stream_equals_batch(spark, tmp_path):
    schema = "contig string, read_start long, pos long, allele string, qual int, nqs boolean, rel_pos double, fwd boolean"
    rows = [("a" if i % 3 else "b", i // 4, i // 4 + i % 7, "ACG"[i % 3], 20 + i % 20, i % 2 == 0, (i % 10) / 10, i % 5 == 0) for i in range(200)]
    parts = [*(rows[k * 50 : k * 50 + 50] for k in range(4)), [(c, FLUSH, FLUSH, "A", 0, False, 0.0, False) for c in "ab"]]
    folder = str(tmp_path / "out")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream_alleles(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), folder).awaitTermination()
        left = {(r["contig"], r["pos"]) for r in open_sites(spark, folder).collect()}
        seen = [r for p in parts[: k + 1] for r in p if r[1] < FLUSH]
        mark = {c: max((r[1] for p in parts[: k + 1] for r in p if r[0] == c)) for c in "ab"}
        assert left == {(r[0], r[2]) for r in seen if r[2] >= mark[r[0]]}
    got = sorted((r["contig"], r["pos"], r["allele"], r["n"], r["qsum"], r["fwd"], round(r["p_any"], 9)) for r in final_alleles(spark, folder).collect())
    batch = allele_counts(spark.createDataFrame(rows, schema), ["contig", "pos"]).collect()
    assert got == sorted((r["contig"], r["pos"], r["allele"], r["n"], r["qsum"], r["fwd"], round(r["p_any"], 9)) for r in batch)
    spark.createDataFrame(rows[:1], schema).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="finalized"):
        stream_alleles(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), folder).awaitTermination()


def test_command_line(spark, tmp_path):
    lines = ["@SQ\tSN:c\tLN:300"]
    for r in snp_reads():
        lines.append("\t".join([r[0], str(r[2]), "c", str(r[4] + 1), "60", "".join(f"{n}{o}" for o, n in r[6]), "*", "0", "0", r[7], "G" * len(r[7]), f"NM:i:{r[9]}"]))
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "r.fa").write_text(f">c\n{R}\n")
    (tmp_path / "t.bed").write_text("c 51 100\n")
    cli.main(["-r", str(tmp_path / "r.fa"), "-b", str(tmp_path / "a.sam"), "-s", "one", "-p", str(tmp_path / "out"), "-c", str(tmp_path / "t.bed"), "-g"], spark)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out_snp.vcf").glob("part-*")))
    body = [x.split("\t") for x in text.split("\n") if x and x[0] != "#"]
    # region 51..100: no coverage, 12 reads from 61, the call at 76, then coverage to 90 and none
    assert [(x[1], x[7].split(";")[0], x[7].rpartition("=")[2]) for x in body if x[4] == "."] == [("51", "END=60", "nocov2cov"), ("61", "END=75", "blocked"), ("77", "END=90", "cov2nocov"), ("91", "END=100", "endofregion")]
    assert [x[1:5] for x in body if x[4] != "."] == [["76", ".", R[75], "T"]]
    indels = "".join(p.read_text() for p in sorted((tmp_path / "out_indel.vcf").glob("part-*")))
    body = [x.split("\t") for x in indels.split("\n") if x and x[0] != "#"]
    assert "low_qual" in indels and {x[4] for x in body} == {"."} and body[0][1] == "51" and "END=100;" in body[-1][7]
    # without regions every contig is one
    cli.main(["-r", str(tmp_path / "r.fa"), "-b", str(tmp_path / "a.sam"), "-s", "one", "-p", str(tmp_path / "all"), "--novar"], spark)
    rows = [x.split("\t") for p in sorted((tmp_path / "all_novar.vcf").glob("part-*")) for x in p.read_text().split("\n") if x]
    assert [int(x[1]) for x in rows] == [p for p in range(1, 301) if p != 76] and {x[6] for x in rows} == {"no_Reads", "no_VariantReads"}
    with pytest.raises(ValueError):
        CallerOptions(min_snp_mapq=0, min_indel_mapq=5)
