"""SQL fragments shared by the twins of the document queries."""

CHARS = """ch as (select doc_id as sample_id, unnest(string_split(text, '')) as c, unnest(range(length(text))) as pos from documents)"""

ENTROPY = CHARS + """,
hist as (select sample_id, pos // 64 as tile, c, count(*) as n from ch group by all),
ent as (select sample_id, tile, cast(sum(n) as bigint) as n_units, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) as entropy from hist group by all)"""

SPANS = """parts as (select doc_id, rule, string_split(text, rule) as p from documents, (values ('the '), (' and '), ('License'), ('@')) as r(rule)),
gap as (select doc_id, rule, unnest(p) as piece, unnest(range(len(p))) as i, len(p) as np from parts),
pos as (select doc_id as sample_id, rule, cast(sum(length(piece)) over (partition by doc_id, rule order by i) + i * length(rule) as bigint) as lo, i, np from gap),
spans as (select sample_id, rule, lo, lo + length(rule) as hi from pos where i < np - 1)"""

MERGED = SPANS + """,
mm as (select *, max(hi) over (partition by sample_id order by lo, hi rows between unbounded preceding and 1 preceding) as pm from spans),
mi as (select *, sum(case when pm is null or pm < lo then 1 else 0 end) over (partition by sample_id order by lo, hi rows unbounded preceding) as isl from mm),
merged as (select sample_id, min(lo) as lo, max(hi) as hi from mi group by sample_id, isl)"""

# tiles with every ranking score and evidence bytes
TILES = ENTROPY + ", " + MERGED + """,
pieces as (select sample_id, lo as interval_id, hi - lo as length, tile, least(hi, (tile + 1) * 64) - greatest(lo, tile * 64) as n_bytes
  from (select *, unnest(range(lo // 64, (hi - 1) // 64 + 1)) as tile from merged)),
pt as (select sample_id, tile, sum(n_bytes) as evidence from pieces group by all),
tl as (select e.sample_id, e.tile, e.n_units as tile_len, e.entropy, cast(coalesce(pt.evidence, 0) as bigint) as evidence,
  max(e.tile) over (partition by e.sample_id) + 1 as n_tiles,
  case when sum(e.n_units) over (partition by e.sample_id) > 4096 then 'long' else 'short' end as stratum,
  round(greatest(coalesce(abs(e.entropy - lag(e.entropy) over w), 0.0), coalesce(abs(e.entropy - lead(e.entropy) over w), 0.0)), 9) as boundary
  from ent e left join pt on pt.sample_id = e.sample_id and pt.tile = e.tile window w as (partition by e.sample_id order by e.tile))"""

RANKS = TILES + """,
rk as (select *, row_number() over (partition by sample_id order by sha256(concat_ws('|', 'tiles-v1', sample_id, tile)), tile) as r_random,
  row_number() over (partition by sample_id order by entropy desc, tile) as r_entropy,
  row_number() over (partition by sample_id order by boundary desc, tile) as r_boundary,
  row_number() over (partition by sample_id order by evidence desc, tile) as r_oracle from tl),
bk as (select rk.*, b.budget, least(n_tiles, greatest(1, cast(ceil(b.budget * n_tiles) as bigint))) as k
  from rk, (values (0.02::double), (0.05::double), (0.10::double), (0.20::double), (0.50::double)) as b(budget)),
uni as (select sample_id, budget, unnest(range(k)) * n_tiles // k as tile from (select distinct sample_id, n_tiles, budget, k from bk)),
sel as (
  select sample_id, stratum, tile, tile_len, evidence, budget, 'random' as selector from bk where r_random <= k
  union all select sample_id, stratum, tile, tile_len, evidence, budget, 'entropy' from bk where r_entropy <= k
  union all select sample_id, stratum, tile, tile_len, evidence, budget, 'entropy_boundary' from bk where r_boundary <= k
  union all select sample_id, stratum, tile, tile_len, evidence, budget, 'oracle' from bk where r_oracle <= k
  union all select sample_id, stratum, tile, tile_len, evidence, budget, 'front_first' from bk where tile < k
  union all select sample_id, stratum, tile, tile_len, evidence, budget, 'back_first' from bk where tile >= n_tiles - k
  union all select bk.sample_id, stratum, bk.tile, tile_len, evidence, bk.budget, 'uniform' from bk join uni using (sample_id, budget, tile))"""

EVAL = RANKS + """,
got as (select sample_id, stratum, selector, budget, sum(evidence) as inter, sum(tile_len) as len, max(evidence) > 0 as hit, count(*) as k from sel group by all),
ivp as (select s.sample_id, s.selector, s.budget, p.interval_id, sum(p.n_bytes) as o, max(p.length) as l
  from sel s join pieces p on p.sample_id = s.sample_id and p.tile = s.tile group by all),
cov as (select sample_id, selector, budget, count(*) as covered from ivp where o / l >= 0.5 group by all),
tot as (select sample_id, sum(hi - lo) as eb, count(*) as ni from merged group by all),
ev as (select g.sample_id, g.stratum, g.selector, g.budget,
  case when coalesce(eb, 0) > 0 then cast(inter as double) / eb end as coverage,
  case when len + coalesce(eb, 0) - inter > 0 then cast(inter as double) / (len + coalesce(eb, 0) - inter) else 0 end as byte_iou,
  case when ni > 0 then cast(coalesce(covered, 0) as double) / ni end as interval_recall_50,
  hit as evidence_hit, k, coalesce(eb, 0) > 0 as has_evidence, coalesce(ni, 0) as n_regions
  from got g left join cov c on c.sample_id = g.sample_id and c.selector = g.selector and c.budget = g.budget left join tot t on t.sample_id = g.sample_id)"""
