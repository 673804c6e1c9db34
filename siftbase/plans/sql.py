"""SQL of the registered core queries, put together from common table expressions. Test data only: nothing here runs in a plan."""

from siftbase.config import ModelParams
from siftbase.plans.evidence import ALLELE, REF

M = ModelParams()
POST = "[" + ", ".join(repr(1.0 / (1.0 + e * M.prior_err / (s * M.prior_snp))) + "::double" for e, s in zip(M.err_prior, M.snp_prior, strict=True)) + "]"

EV = f"""refs as (select p_partkey as pos, {REF} as ref from part),
ev as (select l_suppkey % 3 as contig, pos, ref, {ALLELE} as allele, 2 + cast(l_quantity as int) % 39 as qual,
  l_linestatus = 'O' as fwd, l_orderkey % 3 <> 0 as nqs, (l_orderkey % 100) / 100.0E0 as rel_pos from lineitem join refs on l_partkey = pos),
events as (select * from ev where allele <> ref),
cover as (select contig, pos, count(*) filter (where allele = ref) as rr from ev group by 1, 2)"""


def alleles(site: str) -> str:
    """Per site and allele; needs a CTE ``events``."""
    return f"""al0 as (select {site}, allele, count(*) as n, sum(qual) as qsum, count(*) filter (where fwd) as fwd, 1 - exp(sum(ln(1 - p))) as p_any
  from (select *, 1 / (1 + exp(-({M.snp_intercept}E0 + {M.snp_quality}E0 * qual + {M.snp_nqs}E0 * cast(nqs as int) + {M.snp_rel_pos}E0 * rel_pos))) as p from events) x
  group by {site}, allele),
al as (select *, {POST}[cast(least(9, floor(round(10 * p_any, 9))) as int) + 1] as post from al0)"""


def majority(site: str) -> str:
    return f"""mj as (select *, row_number() over (partition by {site} order by n desc, case when n > 1 then post else 0 end desc, allele) as rk,
  max(n) over (partition by {site}) as top, sum(n) over (partition by {site}) as all_reads from al),
best as (select {site}, m.allele, m.n, m.qsum, m.fwd, m.post, m.all_reads,
  case when m.top > 1 then (select count(*) from al a where {" and ".join(f"a.{c.strip()} = m.{c.strip()}" for c in site.split(","))} and a.n = m.top) else 1 end as ties
  from mj m where rk = 1)"""


FILTERS = """case when list_aggregate(f, 'count') = 0 then 'PASS' else list_aggregate(list_filter(f, lambda x: x is not null), 'string_agg', ';') end"""
SNP_F = """[case when post < 0.95 then 'low_snpqual' end, case when dp < 6 then 'low_coverage' end, case when dp > 8000 then 'high_coverage' end,
 case when dp >= 16 and least(fwd, n - fwd) / n < 0.01 then 'single_strand' end, case when n <= 2 then 'low_VariantReads' end, case when n / dp <= 0.1E0 then 'low_VariantRatio' end]"""
SNP_GT = "case when n / dp <= 0.1E0 then '0/0' when n / dp < 0.9E0 then '0/1' else '1/1' end"
SNP_Q = "cast(round(-10 * log10(1 - post + 1e-6)) as int)"

READS = """rd as (select distinct sample_id, contig, qname, flag, pos, mapq, cigar, seq, qual, nm from aligned_reads),
ok as (select *, length(seq) as lq from rd where flag & 1796 = 0 and len(cigar) > 0 and mapq >= {mapq} and nm is not null and nm <> -1 and contig is not null and pos >= 0),
genome as (select contig, string_agg(upper(seq), '' order by tile_start) as g from (select distinct * from refseq) group by contig)"""


def summed(ops: str, upto: str = "") -> str:
    return f"coalesce(list_sum([x.len for x in cigar{upto} if x.op in ({ops})]), 0)"


SNP_READS = f"""{READS.format(mapq=1)},
s0 as (select *, {summed("'I','D'")} as gap, {summed("'M','I'")} as core from ok where {summed("'M','I','S'")} = lq),
s1 as (select *, nm - gap as sub from s0 where core > 0 and (nm - gap) / core <= 0.05E0 and gap / core <= 0.05E0),
so as (select * exclude (k), cigar[k].op as op, cigar[k].len as n, pos + {summed("'M','D','N','=','X'", "[1:k-1]")} as r, {summed("'M','I','S'", "[1:k-1]")} as q
  from (select *, unnest(range(1, len(cigar) + 1)) as k from s1)),
sb as (select so.* exclude (r, q), r + i as p, q + i as qi, case when sub = 0 then null else substr(g, cast(r + i + 1 as bigint), 1) end as rb, substr(upper(seq), cast(q + i + 1 as bigint), 1) as b
  from (select *, unnest(range(0, n)) as i from so where op in ('M', 'D')) so left join genome using (contig)),
mm as (select * from sb where op = 'M' and sub <> 0 and rb <> b),
mc as (select sample_id, contig, qname, flag, pos, count(*) as c from mm group by all),
ev0 as (select mm.sample_id, mm.contig, mm.qname, mm.flag, cast(p as int) as pos, rb as ref, b as allele, mm.qual[cast(qi + 1 as bigint)] as qual, mm.flag & 16 = 0 as fwd, mm.qual as quals, lq,
  case when mm.flag & 16 = 0 then lq - qi - 1 else qi end as d3, qi
  from mm join mc on mm.sample_id = mc.sample_id and mm.contig = mc.contig and mm.qname = mc.qname and mm.flag = mc.flag and mm.pos = mc.pos where c = sub and rb <> 'N' and b <> 'N'),
events as (select sample_id, contig, qname, flag, pos, ref, allele, qual, d3 / lq as rel_pos, fwd,
  case when lq <= 10 then false when d3 > lq - 6 then true else qi >= 5 and lq - qi >= 6 and qual >= 20 and list_min(quals[cast(qi - 4 as bigint):cast(qi + 6 as bigint)]) >= 15 end as nqs
  from ev0 where qual is not null),
cov as (select sample_id, contig, cast(p as int) as pos, count(*) filter (where op = 'M' and (sub = 0 or rb = b)) as rr, count(*) filter (where op = 'D' or sub = 0 or rb = b) as dp from sb group by all)"""

INDEL_READS = f"""{READS.format(mapq=0)},
i0 as (select *, case when cigar[1].op = 'S' then cigar[1].len else 0 end as lead, case when len(cigar) > 1 and cigar[-1].op = 'S' then cigar[-1].len else 0 end as tail from ok),
io as (select *, lq - lead - tail as rlen, cigar[k].op as op, cigar[k].len as n, pos + {summed("'M','=','X','N','D','P'", "[1:k-1]")} as r, {summed("'M','=','X','N','I'", "[1:k-1]")} as q
  from (select *, unnest(range(1, len(cigar) + 1)) as k from i0)),
spans as (select sample_id, contig, case when op = 'I' then r - 1 else r end as a, case when op = 'I' then r - 1 else r + n - 1 end as z,
  cast(op in ('M','=','X','N') as int) as rr, cast(op <> 'D' as int) as rr_ins, cast(op <> 'I' as int) as dp from io where op in ('M','=','X','N','D') or (op = 'I' and k = 1)),
ms as (select sample_id, contig, qname, flag, pos, count(*) as subs from (
    select io.* exclude (r, q, n), r + i as p, q + i as qi from (select *, unnest(range(0, n)) as i from io where op = 'M' and list_contains([x.op for x in cigar], 'I') or op = 'M' and list_contains([x.op for x in cigar], 'D')) io) b
  join genome using (contig) where substr(g, cast(p + 1 as bigint), 1) <> substr(upper(seq), cast(lead + qi + 1 as bigint), 1) and p < length(g) group by all),
ie as (select io.sample_id, io.contig, cast(r as int) as var_start, op = 'D' as del, n as len, case when op = 'D' then '' else substr(upper(seq), cast(lead + q + 1 as bigint), n) end as bases, io.flag & 16 = 0 as fwd, mapq,
  q + 1 <= 3 or rlen - (case when op = 'D' then q else q + n end) < 5 as near_end,
  greatest(0, q - 5) as qa, least(rlen - 1, (case when op = 'D' then q else q + n end) + 3) as qz, qual, lead,
  (coalesce(subs, 0) + coalesce(list_sum([case when x.op = 'X' then x.len else 1 end for x in cigar if x.op in ('X','I','D')]), 0)) / rlen as var_rate
  from io left join ms on io.sample_id = ms.sample_id and io.contig = ms.contig and io.qname = ms.qname and io.flag = ms.flag and io.pos = ms.pos where op in ('I', 'D')),
ievents as (select sample_id, contig, var_start, del, len, bases, case when del then cast(len as varchar) else bases end as id, fwd, mapq, near_end,
  case when len(qual) >= lead + qz + 1 and qz >= qa then cast(floor(list_sum(qual[cast(lead + qa + 1 as bigint):cast(lead + qz + 1 as bigint)]) / (qz - qa + 1)) as int) end as nbq, var_rate from ie),
im as (select sample_id, contig, var_start, id, del, len, bases, count(*) as n, bool_or(fwd) as any_fwd, bool_or(not fwd) as any_rev, count(*) filter (where near_end) as near_ends,
  avg(nbq) as mean_nbq, avg(mapq) as mean_mapq, avg(var_rate) as mean_var_rate, count(*) filter (where near_end) / count(*) as near_end_ratio from ievents group by sample_id, contig, var_start, id, del, len, bases),
top as (select * exclude (rk) from (select *, row_number() over (partition by sample_id, contig, var_start order by n desc, id) as rk, sum(n) over (partition by sample_id, contig, var_start) as all_reads from im) where rk = 1),
wn as (select t.*, case when var_start <= 10 then 0 when del then var_start - 10 else var_start - 11 end as ws, case when del then var_start + len + 10 else var_start + 11 end as we from top t),
wt as (select wn.*, coalesce(substr(g, cast(ws + 1 as bigint), cast(we - ws as bigint)), '') as win from wn left join genome using (contig)),
km as (select sample_id, contig, var_start, id, kmer, count(*) as c, max(nk) as nk from (
    select *, substr(win, cast(i as bigint), len) as kmer, length(win) - len as nk from (select *, unnest(range(1, length(win) - len + 1)) as i from wt where length(win) > len)) group by all),
en as (select sample_id, contig, var_start, id, -sum(c / (nk + 1) * ln(c / (nk + 1))) as entropy from km group by all),
te as (select wt.* exclude (ws, we, win), coalesce(entropy, 0) as entropy, case when del then wt.var_start else wt.var_start - 1 end as cov_pos from wt left join en on wt.sample_id = en.sample_id and wt.contig = en.contig and wt.var_start = en.var_start and wt.id = en.id),
tc as (select te.sample_id, te.contig, te.var_start, te.id, coalesce(sum(s.rr), 0) as rr, coalesce(sum(s.rr_ins), 0) as rr_ins, coalesce(sum(s.dp), 0) as dp
  from te left join spans s on s.sample_id = te.sample_id and s.contig = te.contig and s.a <= te.cov_pos and s.z >= te.cov_pos group by all)"""


def indel_calls(p: str) -> str:
    return f"""with {INDEL_READS},
sc as (select te.*, tc.rr, tc.rr_ins, tc.dp, {p} as p from te join tc on te.sample_id = tc.sample_id and te.contig = tc.contig and te.var_start = tc.var_start and te.id = tc.id),
sq as (select *, case when 1 - p < 1e-10 then 100 else cast(round(-10 * log10(1 - p)) as int) end as qual, case when del then rr else greatest(0, rr_ins - all_reads) end as ref_reads from sc),
kept as (select *, substr(g, var_start, case when del then len + 1 else 1 end) as ref from sq join genome using (contig) where qual <> 0 and p > 0.109E0 and dp <= 8000 and var_start >= 1),
fl as (select *, [case when n < 2 then 'low_VariantReads' end, case when dp < 5 then 'low_coverage' end, case when n / dp < 0.06E0 then 'low_VariantRatio' end,
  case when near_end_ratio > 0.8E0 then 'read_end_ratio' end, case when p < 0.5E0 then 'low_qual' end] as f from kept)
select sample_id, contig, var_start as pos, ref, case when del then substr(ref, 1, 1) else concat(ref, bases) end as alt, qual, {FILTERS} as filters, round(p, 6) as p,
 case when dp < 5 then '1/.' when n / (n + ref_reads) >= 0.6E0 then '1/1' when n / (n + ref_reads) >= 0.06E0 then '1/0' when ref_reads / (n + ref_reads) >= 0.6E0 then '0/0' else '0/.' end as gt,
 cast(n as int) as vr, cast(ref_reads as int) as rr, cast(dp as int) as dp from fl"""


STRAND, NBQ = "cast(any_fwd and any_rev as int)", "coalesce(mean_nbq, 0)"
P_INDEL = f"""case when dp = 0 then 1 else 1 / (1 + exp(-({M.indel_intercept}E0 + {M.indel_entropy}E0 * entropy + {M.indel_strand}E0 * {STRAND} + {M.indel_nbq}E0 * {NBQ} + {M.indel_norm_var_sq}E0 * (n * n / dp)))) end"""
P_WGS = f"""case when dp = 0 then 1 else 1 / (1 + exp(-({M.wgs_intercept}E0 + {M.wgs_entropy}E0 * entropy + {M.wgs_strand}E0 * {STRAND} + {M.wgs_nbq}E0 * {NBQ} + {M.wgs_mapq}E0 * mean_mapq
  + {M.wgs_var_rate}E0 * mean_var_rate + {M.wgs_norm_var_sq}E0 * (n * n / dp)))) end"""


def _zeros(n: int) -> str:
    return ", ".join(["cast(0 as bigint)"] * n)


_FITS = "greatest({h}, h.{c}) - least({l}, h.{c}) > greatest(0.3E0 * least({l}, h.{c}), 3)"
RECORD_BASES = """v0 as (select sample_id, contig, pos, max({'v': [dp, rr, vr], 'c': alt_allele <> '.'}) as x from (select distinct rec_id, sample_id, contig, pos, dp, rr, vr, alt_allele
    from var_records where contig is not null and pos is not null and dp is not null and rr is not null and vr is not null) group by 1, 2, 3)"""
_TAIL = f"""
w as (select sample_id, contig, pos, x.v[1] as dp, x.v[2] as rr, x.v[3] as vr, x.c as called, case when lag(pos) over s = pos - 1 then 0 else 1 end as st, coalesce(lead(pos) over s <> pos + 1, true) as last
  from v0 window s as (partition by sample_id, contig order by pos)),
g as (select *, sum(st) over (partition by sample_id, contig order by pos rows unbounded preceding) as reg from w),
h as (select *, row_number() over (partition by sample_id, contig, reg order by pos) as i from g),
r(sample_id, contig, reg, i, a, k, d0, d1, r0, r1, v0, v1, ds, dq, rs, rq, vs, vq, ea, ez, why, ek, ed0, ed1, er0, er1, ev0, ev1, eds, edq, ers, erq, evs, evq) as (
  select sample_id, contig, reg, cast(0 as bigint), {_zeros(14)}, cast(null as int), cast(null as int), cast(null as varchar), {_zeros(13)} from h where i = 1
  union all
  select h.sample_id, h.contig, h.reg, h.i, case when anew then h.pos else a end, case when off then 0 when anew then 1 else k + 1 end,
    case when anew then h.dp else least(d0, h.dp) end, case when anew then h.dp else greatest(d1, h.dp) end, case when anew then h.rr else least(r0, h.rr) end, case when anew then h.rr else greatest(r1, h.rr) end,
    case when anew then h.vr else least(v0, h.vr) end, case when anew then h.vr else greatest(v1, h.vr) end, case when anew then h.dp else ds + h.dp end, case when anew then h.dp * h.dp else dq + h.dp * h.dp end,
    case when anew then h.rr else rs + h.rr end, case when anew then h.rr * h.rr else rq + h.rr * h.rr end, case when anew then h.vr else vs + h.vr end, case when anew then h.vr * h.vr else vq + h.vr * h.vr end,
    case when k = 0 then h.pos else a end, case when x.why = 'endofregion' then h.pos else h.pos - 1 end, x.why, k, d0, d1, r0, r1, v0, v1, ds, dq, rs, rq, vs, vq
  from r join h on h.sample_id = r.sample_id and h.contig = r.contig and h.reg = r.reg and h.i = r.i + 1,
  lateral (select h.called or h.last as off, case when h.called then case when k > 0 then 'blocked' end when h.last then 'endofregion' when k = 0 then null
    when h.dp = 0 and d0 > 0 then 'cov2nocov' when d1 = 0 and h.dp > 0 then 'nocov2cov'
    when {_FITS.format(h="d1", l="d0", c="dp")} then 'dp' when {_FITS.format(h="r1", l="r0", c="rr")} then 'rr' when {_FITS.format(h="v1", l="v0", c="vr")} then 'vr' end as why) x,
  lateral (select not x.off and (k = 0 or x.why is not null) as anew) y),
bl as (select sample_id, contig, cast(ea as int) as block_first, cast(ez as int) as block_last, why as reason, cast(ek as bigint) as n_stats,
  case when ek > 0 then ed0 else 0 end as dp_min, case when ek > 0 then ed1 else 0 end as dp_max, case when ek > 0 then round(eds / ek, 6) else 0 end as dp_mean,
  case when ek > 1 then round(sqrt(greatest((edq - eds * eds / ek) / (ek - 1), 0)), 6) else 0 end as dp_sd, eds, edq, ers, erq, evs, evq,
  case when ek > 0 then er0 else 0 end as rr_min, case when ek > 0 then er1 else 0 end as rr_max, case when ek > 0 then ev0 else 0 end as vr_min, case when ek > 0 then ev1 else 0 end as vr_max
from r where why is not null)
"""
_OUT = "sample_id, contig, block_first, block_last, reason, n_stats, dp_min, dp_max, dp_mean, dp_sd, rr_min, rr_max, vr_min, vr_max"


def blocks(bases: str, select: str = f"select {_OUT} from bl") -> str:
    """Blocks ``bl`` over ``v0`` of the common table expressions ``bases``, position by position, and what is selected of them."""
    return f"with recursive {bases},{_TAIL}{select}"


def _four(c: str, total: str, squares: str) -> str:
    mean, sd = f"case when n_stats > 0 then {total} / n_stats else 0 end", f"case when n_stats > 1 then sqrt(greatest(({squares} - {total} * {total} / n_stats) / (n_stats - 1), 0)) else 0 end"
    return f"concat_ws(',', {c}_min, {c}_max, format('{{:.5g}}', cast({mean} as double)), format('{{:.5g}}', cast({sd} as double)))"


BLOCK_LINES = blocks(
    RECORD_BASES + ", genome as (select contig, string_agg(upper(seq), '' order by tile_start) as g from (select distinct * from refseq) group by contig)",
    f"""select coalesce(c.ord, 2147483647) as ord, cast(block_first as bigint) as pos, concat_ws(chr(9), bl.contig, block_first, '.', substr(g, block_first, 1), '.', '.', 'PASS',
  concat('END=', block_last, ';BLOCKAVG_min30p3a;PX=0,0,0,0;VRX=', {_four("vr", "evs", "evq")}, ';RRX=', {_four("rr", "ers", "erq")}, ';DPX=', {_four("dp", "eds", "edq")}, ';breakblock=', reason),
  'GT:VR:RR:DP:GQ', concat('0/0:', vr_min, ':', rr_min, ':', dp_min, ':.')) as line from bl join genome on genome.contig = bl.contig left join contigs c on c.contig = bl.contig""",
)
BLOCKS = blocks(RECORD_BASES)
INDEL_BASES = f"""{{indel_ctes}},
pb as (select sample_id, contig, a + i as pos, rr, dp from (select *, unnest(range(0, cast(z - a + 1 as bigint))) as i from spans)),
pc as (select sample_id, contig, pos, sum(rr) as rr, sum(dp) as dp from pb group by all),
pv as (select sample_id, contig, var_start + i as pos, sum(n) as vr from (select *, unnest(range(0, len)) as i from top where del) group by all),
ca as (select distinct sample_id, contig, pos - 1 as pos from ({{calls}})),
v0 as (select pc.sample_id, pc.contig, cast(pc.pos as int) as pos, {{{{'v': [cast(pc.dp as bigint), cast(pc.rr as bigint), cast(coalesce(pv.vr, 0) as bigint)], 'c': ca.pos is not null}}}} as x
  from pc left join pv on pv.sample_id = pc.sample_id and pv.contig = pc.contig and pv.pos = pc.pos left join ca on ca.sample_id = pc.sample_id and ca.contig = pc.contig and ca.pos = pc.pos)"""
INDEL_BLOCKS = blocks(INDEL_BASES.format(indel_ctes=INDEL_READS, calls=indel_calls(P_INDEL)))
