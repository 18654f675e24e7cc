"""Oracle SQL per query name, over the same views as ``blockscope.fixtures``."""

from __future__ import annotations

import re

from blockscope.fixtures import SETTINGS, VIEWS

FORK = f"timestamp '{SETTINGS.fork}'"
BEFORE = f"timestamp '{SETTINGS.before_fork_end}'"
BOUND = SETTINGS.arrival_ms


def cut(value: str, name: str, places: int = 4) -> str:
    """The same cut to ``places`` decimals as in ``__spark_entry__``."""
    scale = f"{10.0 ** places:.1f}"
    return f"floor(({value})*{scale}+0.37)/{scale} as {name}"


# Relations that several oracles start from.
SHARED: dict[str, str] = {
    "bpb": "select block_root, sum(blob_gas/131072) as num_blobs from tx where type=3 group by 1",
    "bph": "select hash, sum(blob_gas/131072) as num_blobs from tx where type=3 group by 1",
    "tags": "select distinct extra_data from block_details where hash in (select block_hash from mev)",
    "non_mev": """select distinct hash from block_details
  where extra_data not in (select extra_data from tags)""",
    "gas": """select b.num_blobs, g.gas_used, g.hash from bpb b
  join block_root r on b.block_root = r.block_root join block_details g on g.hash = r.block_hash""",
    "size_rows": """select b.num_blobs, coalesce(g.size, 0) as size from bpb b
  left join block_root r on b.block_root = r.block_root left join block_details g on g.hash = r.block_hash""",
    "txns": """select block_root, cast(max(position)+1 as int) as num_of_txns,
  sum(blob_gas/131072) as num_blobs, sum(size) as total_txn_size from tx where type=3 group by 1""",
    "blob_seen": f"""select block_root, client, max(diff_ms)/1000 as bt, max(blob_index)+1 as k
  from sidecar where diff_ms <= {BOUND} group by 1, 2""",
    "blob_seen_l": f"""select block_root, client, max(diff_ms)/1000 as bt, max(blob_index)+1 as k
  from sidecar where diff_ms <= {BOUND} and impl='lighthouse' group by 1, 2""",
    "block_seen": f"""select block, client, max(diff_ms)/1000 as kt from block_ev
  where slot_start >= {FORK} and diff_ms <= {BOUND} group by 1, 2""",
    "block_seen_l": f"""select block, client, max(diff_ms)/1000 as kt from block_ev
  where slot_start >= {FORK} and diff_ms <= {BOUND} and impl='lighthouse' group by 1, 2""",
    "pairs_l": """select bb.block_root, bb.k, greatest(bb.bt, bk.kt) as sec from blob_seen_l bb
  join block_seen_l bk on bb.client = bk.client and bb.block_root = bk.block""",
    "arrivals": """select coalesce(bb.k, 0) as num_blobs, greatest(bb.bt, bk.kt) as sec from block_seen bk
  left join blob_seen bb on bb.client = bk.client and bb.block_root = bk.block""",
    "mean_arr": """select bb.block_root, avg(greatest(bb.bt, bk.kt)) as sec from blob_seen_l bb
  left join block_seen bk on bb.client = bk.client and bb.block_root = bk.block group by 1""",
    "tips": """select coalesce(b.num_blobs, 0) as num_blobs,
  least(greatest(t.max_fee - coalesce(d.base_fee, 0), 0), t.max_priority_fee) as miner_tip
  from tx_details t left join block_details d on t.block_hash = d.hash left join bph b on b.hash = t.hash""",
    "paid": """select b.num_blobs, m.value from bpb b join block_root r on b.block_root = r.block_root
  join mev m on m.block_hash = r.block_hash""",
    "early_blob": f"""select block_root, client, max(diff_ms)/1000 as bt from sidecar
  where diff_ms <= {SETTINGS.tight_arrival_ms} and impl='lighthouse' group by 1, 2""",
    "early_block": f"""select block, client, max(diff_ms)/1000 as kt from block_ev
  where slot_start >= {FORK} and diff_ms <= {SETTINGS.tight_arrival_ms} group by 1, 2""",
    "early": """select bb.block_root, avg(greatest(bb.bt, bk.kt)) as sec from early_blob bb
  left join early_block bk on bb.client = bk.client and bb.block_root = bk.block group by 1""",
    "early_paid": """select e.sec, m.value from early e join block_root r on e.block_root = r.block_root
  join mev m on m.block_hash = r.block_hash""",
    "mev_prop": "select sec, value from early_paid where value <= (select quantile_cont(value, 0.95) from early_paid)",
    "sent": """select l.label, l.address, t.slot, t.blob_gas, t.block_root, t.empty_size, t.full_size
  from tx t join address_labels l on lower(t.to_addr) = l.address where t.type=3""",
    "posts": """select label, address, slot, sum(blob_gas/131072) as num_blobs, count(*) as num_blob_txns
  from sent group by 1, 2, 3""",
    "gaps": f"""select label, address, slot, num_blobs, slot_increment from (
  select *, slot - lag(slot) over (partition by address order by slot) as slot_increment from posts)
  where slot_increment <= {SETTINGS.max_slot_gap}""",
    "top10": """select to_addr, sum(blob_gas/131072) as num_blobs from tx where type=3 group by 1
  order by 2 desc, 1 limit 10""",
    "rel": """select b.block_root, case when m.mp = 0 then null else b.position/m.mp end as rel_position
  from (select block_root, position from tx where type=3) b
  left join (select block_root, max(position) as mp from tx group by 1) m on b.block_root = m.block_root""",
    "reorg_blob": """select b.slot, b.num_blobs, cast(coalesce(r.n, 0) as bigint) as n
  from (select slot, sum(blob_gas/131072) as num_blobs from tx where type=3 group by 1) b
  left join (select slot, country, count(*) as n from reorg where impl='lighthouse' group by 1, 2) r
  on b.slot = r.slot""",
    "mev_medians": "select round(sec, 9) as sec, median(value) as m from mev_prop group by 1",
    "arrival_spans": """select num_blobs, a as lo, (b - a)/1000 as w, total from (select num_blobs,
  case when min(sec) = max(sec) then min(sec) - 0.5 else min(sec) end as a,
  case when min(sec) = max(sec) then max(sec) + 0.5 else max(sec) end as b, count(sec) as total
  from arrivals group by 1)""",
    "user_medians": "select user_id, median(value) as m from events group by 1",
    "expected": """select *, 'k' || o_orderkey as key, floor(o_totalprice) as price,
  cast(o_orderkey as hugeint) * 18446744073709551616 as wide, o_orderpriority = '5-LOW' as low from orders
  where not (o_orderstatus = 'P' and o_orderpriority in ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED'))""",
}

RELATIONS = {**VIEWS, **SHARED}


def with_relations(body: str) -> str:
    """Prefix the views and shared relations that the query uses, in order of definition."""
    used: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name, definition in RELATIONS.items():
            if name not in used and re.search(rf"\b(from|join)\s+{name}\b", text):
                used.add(name)
                queue.append(definition)
    ctes = [f"{name} as ({text})" for name, text in RELATIONS.items() if name in used]
    return (f"with {', '.join(ctes)} " if ctes else "") + body


def hist(source: str, value: str, n: int, columns: str) -> str:
    return f"""select {columns} from (
  select b.bin, s.lo + b.bin*s.w as lo, s.lo + (b.bin+1)*s.w as hi, coalesce(c.n, 0) as n,
    coalesce(c.n, 0)/(s.total*s.w) as density
  from (select cast(range as int) as bin from range({n})) b
  cross join ({_span(source, value, n)}) s
  left join (select bin, count(*) as n from (
    select cast(greatest(least(case when x < lo + f*w then f-1 when x >= lo + (f+1)*w then f+1 else f end,
        {n - 1}), 0) as int) as bin
    from (select {value} as x, s.lo, s.w, floor(({value} - s.lo)/s.w) as f
      from {source} cross join ({_span(source, value, n)}) s where {value} is not null))
    group by 1) c on b.bin = c.bin)"""


def _span(source: str, value: str, n: int) -> str:
    return f"""select a as lo, (b - a)/{n} as w, total from (
    select case when min({value}) = max({value}) then min({value}) - 0.5 else min({value})*1.0 end as a,
      case when min({value}) = max({value}) then max({value}) + 0.5 else max({value})*1.0 end as b,
      count({value}) as total from {source})"""


def box(source: str, by: str, value: str, key: str, places: int = 4) -> str:
    shown = ", ".join(
        cut(text, name, places)
        for text, name in (("q1", "q1"), ("md", "median"), ("q3", "q3"),
                           ("least(wl, q1)", "whisker_lo"), ("greatest(wh, q3)", "whisker_hi"))
    )
    return f"""select {key}, {shown}, n_out from (
  select {key}, q1, md, q3,
    min(case when y between q1-(q3-q1)*1.5 and q3+(q3-q1)*1.5 then y end) as wl,
    max(case when y between q1-(q3-q1)*1.5 and q3+(q3-q1)*1.5 then y end) as wh,
    count(case when y between q1-(q3-q1)*1.5 and q3+(q3-q1)*1.5 then null else 1 end) as n_out
  from (select {by} as {key}, cast({value} as double) as y from {source}) d
  join (select {by} as {key}, quantile_cont(cast({value} as double), 0.25) as q1,
      quantile_cont(cast({value} as double), 0.5) as md,
      quantile_cont(cast({value} as double), 0.75) as q3 from {source} group by 1) q using ({key})
  group by 1, 2, 3, 4)"""


def edges(source: str, value: str, n_edges: int) -> str:
    last = n_edges - 2
    return f"""select l.label, b.bin, cast(b.bin+1 as double) as lo, cast(b.bin+2 as double) as hi,
  coalesce(c.n, 0) as n
  from (select distinct label from {source}) l cross join (select cast(range as int) as bin from range({last + 1})) b
  left join (select label, cast(least(floor({value}) - 1, {last}) as int) as bin, count(*) as n from {source}
    where {value} >= 1 and {value} <= {n_edges} group by 1, 2) c on c.label = l.label and c.bin = b.bin"""


def binned(source: str, x: str, y: str, n: int) -> str:
    return f"""select b.bin, {cut('((b.bin*w.w) + ((b.bin+1)*w.w))/2', 'bin_center')},
  {cut('m.md', 'median_value')}
  from (select cast(range as int) as bin from range({n})) b cross join (select 4.0::double/{n} as w) w
  left join (select bin, median(y) as md from (
    select y, case when x <= f*w then f-1 when x > (f+1)*w then f+1 else f end as bin
    from (select {x} as x, {y} as y, 4.0::double/{n} as w, ceil(({x})/(4.0::double/{n})) - 1 as f from {source}))
    where bin >= 0 and bin < {n} group by 1) m on m.bin = b.bin"""


def density(source: str) -> str:
    return f"""select point, {cut('x', 'x')}, {cut('s*((hi-lo)/50)/(h*sqrt(2*pi()))', 'density')} from (
  select point, x, sum(exp(-0.5*power((x-m)/h, 2))) as s, any_value(h) as h, any_value(lo) as lo, any_value(hi) as hi
  from (select cast(range as int) as point, s.lo + range*(s.hi-s.lo)/199 as x, s.h, s.lo, s.hi, u.m
    from range(200) cross join (select min(m) as lo, max(m) as hi,
      stddev_samp(m)*power(count(m), -0.2) as h from {source}) s cross join {source} u)
  group by 1, 2)"""


def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    # blobs, gas, size
    q["blobs_per_block"] = "select block_root, num_blobs from bpb"
    q["blobs_per_txn"] = "select hash, num_blobs from bph"
    q["block_txn_stats"] = f"""select block_root, {cut('total_txn_size', 'total_txn_size')}, num_of_txns,
  num_blobs from txns where num_of_txns <= (select quantile_cont(num_of_txns, 0.99) from txns)"""
    q["txns_by_blobs"] = """select block_root, num_of_txns, num_blobs from txns
  where num_of_txns <= (select quantile_cont(num_of_txns, 0.99) from txns)"""
    q["gas_by_blobs_rows"] = "select num_blobs, gas_used from gas"
    q["gas_by_blobs_buckets"] = q["gas_by_blobs_rows"]
    mean = f"select num_blobs, {cut('avg(gas_used)', 'gas_used')} from gas"
    only = "where hash in (select hash from non_mev)"
    but = "where hash not in (select hash from non_mev)"
    q["gas_by_blobs_mean"] = f"{mean} group by 1"
    q["gas_by_blobs_nonmev_rows"] = f"select num_blobs, gas_used from gas {only}"
    q["gas_by_blobs_nonmev_mean"] = f"{mean} {only} group by 1"
    q["gas_by_blobs_mev_rows"] = f"select num_blobs, gas_used from gas {but}"
    median = f"select num_blobs, {cut('median(gas_used)', 'gas_used')} from gas {but} group by 1"
    q["gas_by_blobs_median"] = median
    q["gas_by_blobs_series"] = f"""select 'All' as series, * from ({mean} group by 1)
  union all select 'Non-MEV', * from ({mean} {only} group by 1) union all select 'MEV', * from ({median})"""
    q["size_by_blobs"] = f"""select num_blobs, {cut('size', 'size')} from size_rows
  where size <= (select quantile_cont(size, 0.99) from size_rows)"""
    q["non_mev_blocks"] = "select hash from non_mev"
    q["mev_tags"] = "select extra_data from tags"
    half = "cast(sum(case when full_size = 0 then (empty_size > 0)::int when empty_size/full_size > 0.5 then 1 else 0 end) as bigint)"
    q["half_empty_blobs"] = f"""select block_root, sum(blob_gas/131072) as num_blobs, {half} as num_half_empty
  from tx where type=3 group by 1"""
    q["half_empty_blobs_by_sender"] = f"""select label, block_root, sum(blob_gas/131072) as num_blobs,
  {half} as num_half_empty from sent group by 1, 2"""
    ratio = "case when full_size = 0 then null else empty_size/full_size end as empty_ratio"
    q["empty_ratio_by_blobs"] = f"""select block_root, {ratio}, sum(blob_gas/131072) as num_blobs
  from tx where type=3 group by 1, 2"""
    q["empty_ratio_by_sender"] = f"""select label, block_root, {ratio}, sum(blob_gas/131072) as num_blobs
  from sent group by 1, 2, 3"""
    q["box_stats"] = box("gas", "num_blobs", "gas_used", "num_blobs")
    q["gas_nonmev_box"] = box(f"(select * from gas {only})", "num_blobs", "gas_used", "num_blobs")
    q["gas_mev_box"] = box(f"(select * from gas {but})", "num_blobs", "gas_used", "num_blobs")
    q["size_box"] = box(
        "(select * from size_rows where size <= (select quantile_cont(size, 0.99) from size_rows))",
        "num_blobs", "size", "num_blobs",
    )
    q["gas_by_blobs_median_ranges"] = median
    q["box_stats_ranges"] = q["box_stats"]
    q["non_mev_blocks_hot"] = q["non_mev_blocks"]
    mine = "from tx where type=3 and lower(to_addr) = '0xab7' group by"
    q["half_empty_blobs_one_sender"] = f"""select block_root, sum(blob_gas/131072) as num_blobs,
  {half} as num_half_empty {mine} 1"""
    q["empty_ratio_one_sender"] = f"""select block_root, {ratio}, sum(blob_gas/131072) as num_blobs
  {mine} 1, 2"""
    # positions
    shown = f"bin, {cut('lo', 'lo')}, {cut('hi', 'hi')}, n, {cut('density', 'density')}"
    q["blob_position"] = "select block_root, position from tx where type=3"
    q["blob_position_hist"] = hist("(select position from tx where type=3)", "position", 50, shown)
    q["relative_position"] = "select block_root, rel_position from rel"
    q["relative_position_hist"] = hist("rel", "rel_position", 50, shown)
    # arrival
    q["client_arrival"] = f"select block_root, client, {cut('bt', 'blob_prop_time')}, k as num_of_blobs from blob_seen"
    sec = cut("avg(sec)", "propagation_sec")
    q["prop_by_blobs"] = f"select k as num_blobs, {sec} from pairs_l group by 1"
    q["prop_by_blobs_mev"] = f"""select k as num_blobs, {sec} from pairs_l p
  left join block_root r on p.block_root = r.block_root
  where r.block_hash is null or r.block_hash not in (select hash from non_mev) group by 1"""
    q["prop_by_blobs_nonmev"] = f"""select k as num_blobs, {sec} from pairs_l p
  left join block_root r on p.block_root = r.block_root
  where r.block_hash in (select hash from non_mev) group by 1"""
    q["prop_by_blobs_series"] = " union all ".join(
        f"select '{label}' as series, * from ({q[key]})"
        for label, key in (("All", "prop_by_blobs"), ("MEV", "prop_by_blobs_mev"), ("Non-MEV", "prop_by_blobs_nonmev"))
    )
    q["prop_full"] = f"""select coalesce(case when bb.client is null then 0 else bb.k end, 0) as num_blobs,
  {cut('avg(greatest(coalesce(bb.bt, 0), bk.kt))', 'propagation_sec')}
  from blob_seen bb full outer join block_seen bk on bb.client = bk.client and bb.block_root = bk.block
  where not (bk.client is null and bb.client is not null) group by 1"""
    q["prop_over_time"] = f"""select slot_start, {cut('sec', 'propagation_sec')} from (
  select bb.slot_start, median(greatest(bb.bt, bk.kt)) as sec
  from (select block_root, client, slot_start, max(diff_ms)/1000 as bt from sidecar group by 1, 2, 3) bb
  left join (select block, client, max(diff_ms)/1000 as kt from block_ev where slot_start >= {FORK}
    group by 1, 2) bk on bb.client = bk.client and bb.block_root = bk.block group by 1
  union all select slot_start, avg(diff_ms/1000) from block_ev where slot_start < {BEFORE} group by 1)"""
    with_blobs = """select m.block_root, m.sec, coalesce(b.num_blobs, 0) as num_blobs
  from mean_arr m left join bpb b on m.block_root = b.block_root"""
    q["block_prop_all"] = f"""select block_root, {cut('sec', 'propagation_sec')}, num_blobs from ({with_blobs})
  where sec <= (select quantile_cont(sec, 0.99) from mean_arr)"""
    q["block_prop_nonmev"] = f"""select a.block_root, {cut('a.sec', 'propagation_sec')}, a.num_blobs
  from ({with_blobs}) a join block_root r on r.block_root = a.block_root
  where r.block_hash in (select hash from non_mev)"""
    q["slot_prop_txns_mev"] = f"""select a.block_root as slot, t.num_of_txns, {cut('v.value', 'value')},
  {cut('a.sec', 'propagation_sec')} from mean_arr a join txns t on a.block_root = t.block_root
  join mev v on v.slot = t.block_root"""
    q["mev_vs_prop"] = f"select {cut('sec', 'propagation_sec')}, {cut('value', 'value')} from mev_prop"
    q["mev_prop_bins"] = binned("mev_prop", "sec", "value", 100)
    q["mev_prop_line"] = f"""select {cut('regr_slope(value, sec)', 'slope')},
  {cut('regr_intercept(value, sec)', 'intercept')}, {cut('regr_r2(value, sec)', 'r2')},
  cast(regr_count(value, sec) as bigint) as n from mev_prop"""
    q["mev_median_hist"] = hist("mev_medians", "m", 50, f"bin, {cut('lo', 'lo')}, {cut('hi', 'hi')}, n")
    q["mev_median_density"] = density("mev_medians")
    q["last_arrival_density"] = f"""select f.num_blobs, b.bin, {cut('f.lo + b.bin*f.w', 'lo')},
  {cut('f.lo + (b.bin+1)*f.w', 'hi')}, coalesce(c.n, 0) as n,
  {cut('coalesce(c.n, 0)/(f.total*f.w)', 'density')}
  from arrival_spans f cross join (select cast(range as int) as bin from range(1000)) b
  left join (select num_blobs, bin, count(*) as n from (
    select num_blobs, cast(greatest(least(case when sec < lo + f*w then f-1 when sec >= lo + (f+1)*w then f+1
        else f end, 999), 0) as int) as bin
    from (select a.num_blobs, a.sec, s.lo, s.w, floor((a.sec - s.lo)/s.w) as f
      from arrivals a join arrival_spans s on a.num_blobs = s.num_blobs)) group by 1, 2) c
  on c.num_blobs = f.num_blobs and c.bin = b.bin"""
    q["last_arrival_summary"] = f"""select num_blobs, {cut('avg(sec)', 'mean')}, {cut('median(sec)', 'median')},
  count(sec) as n from arrivals group by 1"""
    q["last_arrival_box"] = box("arrivals", "num_blobs", "sec", "num_blobs")
    # tips and payments
    q["miner_tip"] = """select num_blobs, miner_tip from tips
  where miner_tip <= (select quantile_cont(cast(miner_tip as double), 0.95) from tips)"""
    q["miner_tip_hot"] = q["miner_tip"]
    q["mev_by_blobs"] = """select num_blobs, value/1e18 as mev_extracted from paid
  where value <= (select quantile_cont(value, 0.95) from paid)"""
    q["miner_tip_box"] = box(
        "(select * from tips where miner_tip <= (select quantile_cont(cast(miner_tip as double), 0.95) from tips))",
        "num_blobs", "miner_tip", "num_blobs",
    )
    q["mev_box"] = box(
        "(select num_blobs, value/1e18 as v from paid where value <= (select quantile_cont(value, 0.95) from paid))",
        "num_blobs", "v", "num_blobs", 18,
    )
    # senders
    q["posting_gap"] = "select label, address, slot, num_blobs, slot_increment from gaps"
    q["sender_blob_txns"] = "select label, address, slot, num_blobs, num_blob_txns from posts"
    q["sender_blob_txns_hot"] = q["sender_blob_txns"]
    q["top_senders"] = "select to_addr, num_blobs from top10"
    q["top_sender_behaviour"] = f"""select t.address, coalesce(l.label, '') as label,
  {cut('median(t.b/t.n)', 'num_blob_per_txn')} from (
  select slot, lower(to_addr) as address, sum(blob_gas/131072) as b, count(*) as n from tx
  where type=3 and to_addr in (select to_addr from top10) group by 1, 2) t
  left join address_labels l on t.address = l.address group by 1, 2"""
    q["histogram_edges_by_sender"] = edges("gaps", "slot_increment", SETTINGS.max_slot_gap)
    q["blobs_per_post_hist"] = edges("posts", "num_blobs", 6)
    # reorgs
    q["reorg_mean_country"] = f"""select date, impl, {cut('avg(n)', 'num_of_reorg_events')} from (
  select cast(slot_start as date) as date, impl, country, count(*) as n from reorg
  where country not in ('FI', 'IN') group by 1, 2, 3) group by 1, 2"""
    q["reorg_by_country"] = f"""select cast(slot_start as date) as date, impl, country,
  count(*) as num_of_reorg_events from reorg where slot_start >= {FORK} and country <> 'IN' group by 1, 2, 3"""
    q["reorg_vs_blobs"] = "select slot, num_blobs, n as num_of_reorg_events from reorg_blob"
    q["line_series"] = f"""select impl, date, {cut('avg(n)', 'mean')}, count(n) as n,
  cast(date >= {FORK} as int) as after_reference from (
  select cast(slot_start as date) as date, impl, country, count(*) as n from reorg
  where country <> 'IN' group by 1, 2, 3) group by impl, date"""
    q["reorg_box"] = box("reorg_blob", "num_blobs", "n", "num_blobs")
    # generic operators
    q["scan_project_filter"] = "select block_root, position, blob_gas from tx where type=3"
    q["prop_bound"] = f"""select block_root, client, {cut('diff_ms', 'diff_ms')} from sidecar
  where diff_ms <= {SETTINGS.tight_arrival_ms}"""
    q["time_range"] = f"""select block, client, {cut('diff_ms', 'diff_ms')} from block_ev
  where slot_start >= {FORK}"""
    q["facet_split"] = "select slot, impl from reorg where impl='lighthouse'"
    q["trim_quantile"] = f"""select hash, {cut('size', 'size')} from block_details
  where size <= (select quantile_cont(size, 0.95) from block_details)"""
    q["trim_quantile_ranges"] = q["trim_quantile"]
    q["finite_pairs"] = f"""select {cut('empty_size/full_size', 'x')}, {cut('size', 'y')} from tx
  where full_size <> 0 and not (type = 2 and empty_size > 0.05)"""
    q["left_join_fill"] = f"""select r.block_root, {cut('coalesce(d.gas_used, 0)', 'gas_used')}
  from block_root r left join block_details d on d.hash = r.block_hash"""
    q["full_join_fill"] = f"""select coalesce(bb.block_root, bk.block) as block_root,
  coalesce(bb.client, bk.client) as client, {cut('coalesce(bb.bt, 0)', 'blob_prop_time')},
  coalesce(bb.k, 0) as num_of_blobs, {cut('coalesce(bk.kt, 0)', 'block_prop_time')}
  from blob_seen bb full outer join block_seen bk on bb.client = bk.client and bb.block_root = bk.block"""
    q["gap_to_previous"] = """select address, slot,
  slot - lag(slot) over (partition by address order by slot) as slot_increment from posts"""
    q["gap_to_previous_null_group"] = """select address, slot,
  slot - lag(slot) over (partition by address order by slot) as slot_increment from (
  select distinct case when length(address) > 4 then address end as address, slot from posts)"""
    q["binned_median"] = binned("events", "value/100", "value", 100)
    q["regression_line"] = f"""select {cut('regr_slope(size, x)', 'slope')},
  {cut('regr_intercept(size, x)', 'intercept')}, {cut('regr_r2(size, x)', 'r2')}, cast(count(*) as bigint) as n
  from (select blob_gas/131072 as x, size from tx)"""
    q["histogram_equal_width"] = hist(
        "events", "value", 50, f"bin, {cut('lo', 'lo')}, {cut('hi', 'hi')}, n"
    )
    q["histogram_density"] = hist(
        "events", "value", 1000, f"bin, {cut('lo', 'lo')}, {cut('hi', 'hi')}, {cut('density', 'density', 8)}"
    )
    q["box_outliers"] = f"""select event_id, event_type, {cut('value', 'value')} from events join (
  select event_type, q1-(q3-q1)*1.5 as a, q3+(q3-q1)*1.5 as b from (
  select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1))
  using (event_type) where value < a or value > b"""
    q["kde_grid"] = density("user_medians")
    q["kde_binned"] = f"""select point, x, {cut('density / max(density) over ()', 'height', 2)}
  from ({density('(select value as m from events)')})"""
    # results kept up to date
    q["prop_by_blobs_kept"] = q["prop_by_blobs"]
    q["arrival_sketches"] = """select blob_index, count(*) as n, true as median_within, true as p95_within from sidecar
  where slot_start >= '2024-01-05' and slot_start < '2024-01-20' group by 1"""
    q["gas_by_blobs_mev_kept"] = q["gas_by_blobs_mev_rows"]
    q["attempt_ledger"] = """select key, least(fails + 1, 6) as tries, fails < 6 as done, fails >= 6 as given_up from (
  select o_orderkey as key, case o_orderpriority when '2-HIGH' then 1 when '3-MEDIUM' then 3
    when '4-NOT SPECIFIED' then 5 when '5-LOW' then 99 else 0 end as fails from orders)"""
    q["hex_to_int"] = """select o_orderkey as key, case o_orderpriority when '4-NOT SPECIFIED' then null
  when '5-LOW' then cast(cast(o_orderkey as hugeint) * 18446744073709551616 as varchar)
  else cast(o_orderkey as varchar) end as value from orders"""
    q["hex_to_int_long"] = "select o_orderkey as key, cast(o_orderkey as varchar) as value from orders"
    q["int_to_hex"] = "select o_orderkey as key, '0x' || lower(to_hex(o_orderkey)) as value from orders"
    q["bytes_to_text"] = "select o_orderkey as key, o_orderpriority as value from orders"
    # work lists
    q["work_list"] = "select distinct hash from tx where type=3"
    q["work_list_since"] = "select distinct hash from tx where type=3 and epoch_start >= timestamp '2000-01-01'"
    q["work_list_remaining"] = """select distinct hash from tx where type=3 and hash not in (
  select hash from tx_details where block_hash in (select hash from block_details))"""
    q["number_work_list"] = """select range as number, '0x' || lower(to_hex(range)) as parameter
  from range((select max(o_orderkey) + 1 from orders))"""
    q["low_water_mark"] = "select min(slot)-1 as slot from mev"
    # daily files
    q["load_day_range"] = "select event_id, ts, user_id from events where ts >= '2024-01-01' and ts < '2024-01-31'"
    q["load_days_over_month_end"] = """select event_id, ts + interval 20 days as ts from events
  where ts + interval 20 days >= '2024-01-28' and ts + interval 20 days < '2024-02-04'"""
    per_day = "select cast(ts as date) as day, cast(count(*) as bigint) as rows from events group by 1"
    q["load_manifest"] = per_day
    q["full_refresh"] = per_day
    q["load_repeated"] = f"""select day, case when day = date '2024-01-01' then 2 * rows else rows end as rows
  from ({per_day})"""
    q["refresh_under_readers"] = """select reader, o_orderstatus, cast(count(*) as bigint) as rows
  from orders, (values ('before'), ('after')) r(reader) where reader = 'before' or o_orderstatus <> 'P' group by 1, 2"""
    # landed responses
    q["land_receipts"] = """select key, '0xb' || o_orderkey as blockHash, cast(o_orderkey as varchar) as blockNumber,
  cast(null as varchar) as contractAddress, cast(cast(floor(o_totalprice*100) as bigint) as varchar) as cumulativeGasUsed,
  cast(wide as varchar) as effectiveGasPrice, '0xf' || o_orderkey as "from",
  cast(cast(price as bigint) as varchar) as gasUsed, 1 as status,
  case when not low then '0xt' || o_orderkey end as "to", '0x' || o_orderkey as transactionHash,
  o_custkey as transactionIndex, 3 as type from expected"""
    q["land_blocks"] = """select key, cast(cast(floor(o_totalprice*10) as bigint) as varchar) as baseFeePerGas,
  case when not low then cast(o_orderkey*131072 as varchar) end as blobGasUsed,
  cast(null as varchar) as excessBlobGas, 'tag' || o_custkey as extraData, '30000000' as gasLimit,
  cast(cast(price as bigint) as varchar) as gasUsed, '0xb' || o_orderkey as hash, '0xm' || o_orderkey as miner,
  cast(o_orderkey as varchar) as number, '0xr' || o_orderkey as receiptsRoot,
  cast(cast(floor(o_totalprice/10) as bigint) as varchar) as size,
  cast(cast(epoch(o_orderdate) as bigint) as varchar) as timestamp from expected"""
    q["land_transactions"] = """select key, '0xb' || o_orderkey as blockHash,
  cast(o_orderkey as varchar) as blockNumber, '1' as chainId, '0xf' || o_orderkey as "from",
  cast(cast(price as bigint) as varchar) as gas, cast(cast(floor(o_totalprice*10) as bigint) as varchar) as gasPrice,
  '0x' || o_orderkey as hash, cast(wide as varchar) as maxFeePerGas,
  cast(cast(floor(o_totalprice*100) as bigint) as varchar) as maxPriorityFeePerGas, o_custkey as nonce,
  '0xt' || o_orderkey as "to", o_custkey as transactionIndex, cast(3 as bigint) as type,
  cast(wide + 18446744073709551615 as varchar) as value from expected"""
    q["land_payload_header"] = """select key as block_root, '0xb' || o_orderkey as block_hash,
  cast(o_orderkey as varchar) as block_number, 'tag' || o_custkey as extra_data,
  cast(cast(floor(o_totalprice*10) as bigint) as varchar) as base_fee_per_gas,
  case when not low then '131072' end as blob_gas_used from expected"""
    q["payload_defaults"] = """select case when low then '' else '0xp' || o_orderkey end as parent_hash,
  cast(o_orderkey as varchar) as fee_recipient, '0xs' || o_orderkey as state_root, '' as receipts_root,
  '' as logs_bloom, '' as prev_randao, cast(o_orderkey as varchar) as block_number, '30000000' as gas_limit,
  case when low then '0' else cast(cast(price as bigint) as varchar) end as gas_used, '0' as timestamp,
  'tag' || o_custkey as extra_data, cast(cast(floor(o_totalprice*10) as bigint) as varchar) as base_fee_per_gas,
  '0xb' || o_orderkey as block_hash, '' as transactions_root, '' as withdrawals_root,
  case when not low then '131072' end as blob_gas_used, cast(null as varchar) as excess_blob_gas,
  key as block_root from expected"""
    q["split_rejects"] = """select case when reason = '' then 'good' else 'reject' end as status, reason,
  count(*) as rows from (select case when o_orderstatus <> 'P' then '' else case o_orderpriority
    when '1-URGENT' then 'no_result' when '2-HIGH' then 'http_status' when '3-MEDIUM' then 'malformed'
    when '4-NOT SPECIFIED' then 'bad_number' else '' end end as reason from orders) group by 1, 2"""
    q["retry_list"] = """select 'k' || o_orderkey as key, cast(1 as bigint) as tries from orders
  where o_orderstatus = 'P' and o_orderpriority <> '5-LOW'"""
    # relays and layouts
    q["relay_union_dedup"] = f"""select block_hash, relay, {cut('value', 'value')} from (
  select *, row_number() over (partition by block_hash order by relay) as rn from relay_bids) where rn = 1"""
    q["land_relay_pages"] = q["relay_union_dedup"]
    q["relay_page_rejects"] = """select relay, outcome, cast(count(*) as bigint) as rows from (
  select distinct relay, 'malformed' as outcome, floor(slot/100) as page, 0 as slot, 0 as value from relay_bids
    where floor(slot/100)::bigint % 10 = 3
  union all select relay, case when slot % 50 = 7 then 'bad_number' else 'good' end, 0, slot, value from relay_bids
    where floor(slot/100)::bigint % 10 <> 3) group by 1, 2"""
    q["relay_unseen_slots"] = """select relay, min(slot) as low, max(slot) as high from (
  select relay, slot, slot - row_number() over (partition by relay order by slot) as island
  from (select relay, unnest(range((select min(slot) from relay_bids), (select max(slot) + 1 from relay_bids))) as slot
    from (values ('a'), ('b'), ('c'), ('d')) r(relay)) walked
  anti join (select distinct relay, unnest(range(low, high + 1)) as slot from (
    select relay, min(slot) as low, page * 100 + case when page % 7 = 3 then 130 else 99 end as high
    from (select relay, slot, floor(slot/100)::bigint as page from relay_bids)
    where page % 10 not in (3, 5) and (page % 7 <> 2 or slot % 100 >= 60) group by relay, page)) seen
  using (relay, slot)) group by relay, island"""
    q["typed_append"] = f"select block_hash, {cut('value', 'value')} from relay_bids"
    q["sorted_layout"] = f"select hash, {cut('gas_used', 'gas_used')}, extra_data from block_details"
    q["alternate_layout"] = f"""select block_root, client, impl, {cut('diff_ms', 'diff_ms')} from sidecar
  where impl = 'lighthouse'"""
    # streams
    q["stream_landing"] = q["land_receipts"]
    q["stream_relay_dedup"] = q["relay_union_dedup"]
    q["stream_relay_corrections"] = q["relay_union_dedup"]
    q["stream_first_arrivals"] = q["relay_union_dedup"].replace("order by relay", "order by relay desc")
    return q


def all_queries() -> dict[str, str]:
    return {name: with_relations(body) for name, body in _queries().items()}
