import datetime as dt

import __spark_entry__ as entry


def test_target_overlap_takes_the_span_of_the_cigar(spark, tmp_path):
    spark.createDataFrame([(1, "c", 110, 119)], "target_id long, contig string, coord_first int, coord_second int").write.parquet(str(tmp_path / "targets.parquet"))
    reads = [
        ("deletion", 95, [("M", 5), ("D", 20), ("M", 5)], "A" * 10), ("skip", 95, [("M", 5), ("N", 10), ("M", 5)], "A" * 10), ("empty", 100, [("M", 20)], ""),
        ("clip", 100, [("M", 5), ("S", 20)], "A" * 25), ("insertion", 100, [("M", 5), ("I", 20)], "A" * 25), ("none", 100, None, "A" * 20),
    ]
    schema = "qname string, pos int, cigar array<struct<op:string,len:int>>, seq string, sample_id long, contig string, flag int"
    spark.createDataFrame([(*r, 1, "c", 0) for r in reads], schema).write.parquet(str(tmp_path / "aligned_reads.parquet"))
    assert [tuple(r) for r in entry.queries()["target_overlap"](spark, str(tmp_path)).collect()] == [(1, "c", 3)]


def test_stream_caller_flushes_the_last_position(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 4), "ab"[i % 2], float(i)) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["stream_caller"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in got) == 12
    assert len({(r["contig"], r["pos"]) for r in got}) == 6
