"""Registered queries of the training-data operators tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftbase.llm.bpe import encode_corpus
from siftbase.llm.mixture import Mixture, mix_sources
from siftbase.llm.mojibake import find_garbled, restore_garbled
from siftbase.llm.quantiles import above_median, multi_select, summarise
from siftbase.llm.runs import collapse_runs
from siftbase.llm.split import letter_stretches, split_items
from siftbase.session import distinct_rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RUNS_SQL = """
with recursive v as (select distinct rec_id, sample_id, contig, pos, dp, rr, vr from var_records
  where contig is not null and pos is not null and dp is not null and rr is not null and vr is not null and alt_allele = '.'),
o as (select *, row_number() over w as rn, case when pos - lag(pos) over w = 1 then 0 else 1 end as jump
  from v window w as (partition by sample_id, contig order by pos, rec_id)),
n as (select *, sum(jump) over (partition by sample_id, contig order by rn rows unbounded preceding) as isl from o),
m as (select *, row_number() over (partition by sample_id, contig, isl order by rn) as k from n),
r as (
  select sample_id, contig, isl, k, pos, pos as a, dp as d0, dp as d1, rr as r0, rr as r1, vr as v0, vr as v1 from m where k = 1
  union all
  select m.sample_id, m.contig, m.isl, m.k, m.pos, case when f then r.a else m.pos end,
    case when f then least(d0, dp) else dp end, case when f then greatest(d1, dp) else dp end,
    case when f then least(r0, rr) else rr end, case when f then greatest(r1, rr) else rr end,
    case when f then least(v0, vr) else vr end, case when f then greatest(v1, vr) else vr end
  from r join (select * from m) m on m.sample_id = r.sample_id and m.contig = r.contig and m.isl = r.isl and m.k = r.k + 1,
  lateral (select 10 * (greatest(d1, dp) - least(d0, dp)) <= greatest(30, 3 * least(d0, dp))
    and 10 * (greatest(r1, rr) - least(r0, rr)) <= greatest(30, 3 * least(r0, rr))
    and 10 * (greatest(v1, vr) - least(v0, vr)) <= greatest(30, 3 * least(v0, vr))
    and ((d0 = 0) = (dp = 0)) as f) x),
g as (select sample_id, contig, a as pos_first, max(pos) as pos_last, count(*) as n_records, max(pos) - a + 1 as n_bases
  from r group by sample_id, contig, isl, a)
"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "var_records").where("contig is not null and alt_allele = '.'")
    return collapse_runs(rows, ["sample_id", "contig"], "pos", ["dp", "rr", "vr"], "rec_id", zero_splits="dp")


@query(RUNS_SQL + "select sample_id, contig, pos_first, pos_last from g where n_records > 1")
def p1_found(spark, sf):
    """Stretches of two or more neighbouring records with nearly the same dp, rr and vr."""
    return _runs(spark, sf).where("n_records > 1").select("sample_id", "contig", "pos_first", "pos_last")


@query(RUNS_SQL + "select sample_id, contig, pos_first, pos_last, n_records, cast(n_bases as bigint) as n_bases from g")
def p1_runs(spark, sf):
    """Every stretch, single records too, with its number of records and its length in bases."""
    return _runs(spark, sf)


@query()
def p1_segments(spark, sf):
    """The runs that cost least when squared deviations inside a run count beside its boundary."""
    rows = table(spark, sf, "var_records").where("contig is not null and alt_allele = '.'")
    return collapse_runs(rows, ["sample_id", "contig"], "pos", ["dp", "rr", "vr"], "rec_id", zero_splits="dp", penalty=4.0, weight=0.5)


def _depths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "var_records").where("contig is not null and dp is not null")
    return distinct_rows(rows.withColumn("day", F.to_date("called_at")), "rec_id", "contig", "dp", "day")


@query("""
with v as (select distinct rec_id, contig, dp from var_records where contig is not null and dp is not null),
o as (select contig, dp, row_number() over (partition by contig order by dp) as rn, count(*) over (partition by contig) as n from v),
m as (select contig, max(case when rn = ceil(0.5 * n) then dp end) as med from o group by contig)
select distinct rec_id from v join m using (contig) where dp > 10 * med""")
def p4_found(spark, sf):
    """Records whose depth is more than ten times the median of their contig."""
    medians = multi_select(summarise(_depths(spark, sf), "contig", "dp", "day"), "contig", [0.5])
    rows = table(spark, sf, "var_records").where("contig is not null and dp is not null").select("rec_id", "contig", "dp")
    return above_median(rows, medians, "contig", "dp", 10.0).select("rec_id").distinct()


PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query(f"""
with v as (select distinct rec_id, contig, dp from var_records where contig is not null and dp is not null),
o as (select contig, dp, row_number() over (partition by contig order by dp) as rn, count(*) over (partition by contig) as n from v),
q as (select unnest([{", ".join(f"{q}::double" for q in PERCENTILES)}]) as quantile)
select contig, quantile, cast(dp as double) as value, n from o join q on rn = greatest(1, ceil(quantile * n))""")
def p4_percentiles(spark, sf):
    """Percentiles of depth per contig from summaries per day of calling."""
    return multi_select(summarise(_depths(spark, sf), "contig", "dp", "day"), "contig", list(PERCENTILES))


@query("""
with v as (select distinct rec_id, contig, dp, cast(called_at as date) as day from var_records where contig is not null and dp is not null)
select contig, day, count(*) as n, count(distinct dp) as n_values, cast(min(dp) as double) as lowest, cast(max(dp) as double) as highest
from v group by contig, day""")
def p4_day_summaries(spark, sf):
    """The mergeable summaries themselves, one line per contig and day."""
    s = summarise(_depths(spark, sf), "contig", "dp", "day")
    return s.groupBy("contig", "day").agg(
        F.sum(F.element_at("below", -1)).alias("n"),
        F.sum(F.size("values")).cast("long").alias("n_values"),
        F.min(F.element_at("values", 1)).alias("lowest"),
        F.max(F.element_at("values", -1)).alias("highest"),
    )


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


@query()
def p6_ids(spark, sf):
    """The ids of every document's text."""
    return _ids(spark, sf)


@query()
def p6_found(spark, sf):
    """Documents without ids."""
    return _ids(spark, sf).where(F.size("ids") == 0).select("doc_id")


def _mixture(spark: SparkSession, sf: str) -> Mixture:
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_plan"))


@query()
def p7_found(spark, sf):
    """Sources that can't reach their share within their permitted repeats."""
    return _mixture(spark, sf).shares.where("short").select("source")


@query()
def p7_mix(spark, sf):
    """The mixture itself: which document goes where, and for the how-manieth time."""
    return _mixture(spark, sf).rows


@query()
def p7_shares(spark, sf):
    """Target and reached shares of every source of the plan."""
    return _mixture(spark, sf).shares


def _split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "targets").where("contig is not null and coord_first <= coord_second")
    targets = distinct_rows(rows, "target_id", "panel_id", "contig", "coord_first", "coord_second")
    limits = table(spark, sf, "panels").select("panel_id", "max_len", "overlap_len")
    return split_items(targets.join(limits, "panel_id"), letter_stretches(table(spark, sf, "refseq")), "target_id", "contig", "coord_first", "coord_second", "max_len", "overlap_len")


@query("""
with t as (select distinct target_id, contig, coord_first as a, coord_second as z from targets join panels using (panel_id)
  where contig is not null and coord_first <= coord_second and coord_second - coord_first + 1 > max_len),
b as (select contig, tile_start + unnest(range(length(seq))) as pos, unnest(string_split(upper(seq), '')) as base from (select distinct * from refseq)),
n as (select contig, pos, pos - row_number() over (partition by contig order by pos) as isl from b where base = 'N'),
s as (select contig, min(pos) as f, max(pos) as l from n group by contig, isl having count(*) >= 10)
select target_id, cast(coalesce(f, -1) as int) as cut_first from t left join s on s.contig = t.contig and f >= a and l <= z""")
def p3_found(spark, sf):
    """The stretches of N inside each target that is too long, from the pieces they fell into; -1 where there is none."""
    rows = _split(spark, sf)
    pieces = rows.select("target_id", "boundaries", F.explode("pieces").alias("_p")).select("target_id", F.explode("_p.stretches").alias("cut_first"))
    none = rows.where(~F.exists("pieces", lambda p: F.size(p["stretches"]) > 0)).select("target_id", F.lit(-1).cast("long").alias("cut_first"))
    return pieces.unionByName(none).select("target_id", F.col("cut_first").cast("int").alias("cut_first"))


@query()
def p3_pieces(spark, sf):
    """The pieces of each target that is too long, and the stretch of N at which each begins."""
    rows = _split(spark, sf).select("target_id", "contig", F.posexplode("pieces").alias("piece_no", "_p"))
    return rows.select(
        "target_id", "contig", "piece_no",
        F.col("_p.first").cast("int").alias("piece_first"), F.col("_p.second").cast("int").alias("piece_second"), F.col("_p.cut_first").cast("int").alias("cut_first"),
    )


@query("""
select target_id, contig, coord_first as covered_first, coord_second as covered_second, coord_second - coord_first + 1 as n_bases, true as in_limit, true as shared_right, true as at_boundary
from (select distinct target_id, contig, coord_first, coord_second, panel_id from targets where contig is not null and coord_first <= coord_second) join panels using (panel_id)
where coord_second - coord_first + 1 > max_len""")
def p3_checks(spark, sf):
    """What holds of the pieces of each target: the bases they cover, each once but for the shared ones, their limit, what neighbours share, and that no cut lies before its stretch."""
    limits = table(spark, sf, "targets").join(table(spark, sf, "panels"), "panel_id").select("target_id", "max_len", "overlap_len").distinct()
    rows = p3_pieces(spark, sf).join(limits, "target_id")
    w = Window.partitionBy("target_id", "contig").orderBy("piece_no")
    before = F.lag("piece_second").over(w)
    shared = F.least(F.coalesce("overlap_len", F.lit(0)), F.col("max_len") - 1)
    rows = rows.withColumn("_shared", before - F.col("piece_first") + 1).withColumn("_length", F.col("piece_second") - F.col("piece_first") + 1)
    cut = F.col("piece_first") + F.floor(shared / 2)
    ok = (F.col("cut_first") < 0) | (F.col("cut_first") <= cut)
    return rows.groupBy("target_id", "contig").agg(
        F.min("piece_first").alias("covered_first"), F.max("piece_second").alias("covered_second"), F.sum(F.col("_length") - F.coalesce("_shared", F.lit(0))).alias("n_bases"),
        F.bool_and(F.col("_length").between(1, F.col("max_len"))).alias("in_limit"), F.bool_and(F.col("_shared").isNull() | (F.col("_shared") == shared)).alias("shared_right"), F.bool_and(ok).alias("at_boundary"),
    )


@query()
def p8_found(spark, sf):
    """Documents with at least one stretch that was decoded with a wrong encoding."""
    return find_garbled(table(spark, sf, "documents")).select("doc_id")


@query()
def p8_restored(spark, sf):
    """Their texts with the originals put back where these can be regained."""
    return restore_garbled(table(spark, sf, "documents"))
