"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

import re

from ..functions.signatures import PRIME, permutations

A, B = permutations()
_LISTS = f"{A}::bigint[]", f"{B}::bigint[]"


def _signatures(members: str) -> str:
    """Signature and bands of (room, sg, member)."""
    h = "('0x' || substr(md5(cast(member as varchar)), 1, 8))::bigint"
    bands = ", ".join(f"('0x' || substr(md5(array_to_string(minhash[{8 * k + 1}:{8 * k + 8}], ',')), 1, 8))::bigint" for k in range(16))
    return f"""
      select *, [{bands}] as lsh_bands from (
        select room, sg, list(v order by p) as minhash from (
          select room, sg, p, min((h * a + b) % {PRIME}) as v
          from (select distinct room, sg, {h} % {PRIME} as h from {members}) cross join perms
          group by room, sg, p) group by room, sg)"""


def _best(probes: str, column: str, side: str, hashes: str = "hashes") -> str:
    sign = "" if side == "<" else "-"
    return f"""
      select room, probe, arg_max(sg, [similarity, {sign}sg]) as match, max(similarity) as similarity from (
        select p.room, p.sg as probe, c.sg, len(list_filter(list_zip(c.minhash, p.minhash), lambda z: z[1] = z[2])) / 128 as similarity
        from {probes} p join {hashes} c on p.room = c.room and c.sg {side} p.sg and list_has_any(c.{column}, p.{column}))
      group by room, probe"""


def _solved(paths: str) -> str:
    """Ranks from the longest ``path`` of each room."""
    return f"select room, unnest(path) as segment, generate_subscripts(path, 1) - 1 as rank from (select room, arg_max(path, len(path)) as path from {paths} group by room)"


def _hilbert(name: str, dims: int) -> str:
    """Keys of the points x of ``name``_steps once all its steps are made."""
    bits = min(63, 8 * dims)
    return f"""
      select room, sg, cast(list_sum(list_transform(range({bits}), lambda p: ((xor(y[p % {dims} + 1], t) >> (7 - p // {dims})) & 1) << ({bits} - 1 - p))) as bigint) as ordering
      from (select *, list_reduce(list_transform([128, 64, 32, 16, 8, 4, 2, 1], lambda q: case when y[{dims}] & q <> 0 then q - 1 else 0 end), lambda a, b: xor(a, b)) as t
        from (select room, sg, list_transform(range(1, {dims + 1}), lambda k: list_reduce(x[1:k], lambda a, b: xor(a, b))) as y from {name}_steps where s = {7 * dims}))"""


def _hilbert_steps(name: str, dims: int, start: str) -> str:
    q, i = f"(128 >> (s // {dims}))", f"(s % {dims} + 1)"
    return f"""
      select room, sg, {start} as x, 0 as s from hashes union all
      select room, sg, case when x[{i}] & {q} <> 0 then list_transform(x, lambda v, k: case when k = 1 then xor(v, {q} - 1) else v end)
        else list_transform(x, lambda v, k: case when k = 1 or k = {i} then xor(v, xor(x[1], x[{i}]) & ({q} - 1)) else v end) end, s + 1
      from {name}_steps where s < {7 * dims}"""


CTES = {
    "ev": """select event_id as sg, '!r' || (user_id // 10) as room, event_type as typ, cast(user_id as varchar) as skey, event_id as eid,
               row_number() over (partition by user_id // 10 order by event_id) as rn from events""",
    "deltas": """select sg, room, typ, skey, eid from ev where rn % 97 <> 1 union all
               select a.sg, a.room, b.typ, b.skey, max(b.eid) from ev a join ev b on a.room = b.room and b.rn <= a.rn
               where a.rn % 97 = 1 group by a.sg, a.room, b.typ, b.skey""",
    "edges": """select a.room, a.sg, b.sg as prev from ev a join ev b on a.room = b.room and b.rn =
               case when a.rn % 31 = 0 and a.rn > 20 and (a.rn - 1) // 97 = (a.rn - 21) // 97 then a.rn - 20 else a.rn - 1 end
               where a.rn % 97 <> 1""",
    "closure": "select room, sg, sg as anc, 0::bigint as depth from ev union all select c.room, c.sg, e.prev, c.depth + 1 from closure c join edges e on e.sg = c.anc",
    "state": "select c.room, c.sg, d.typ, d.skey, arg_min(d.eid, c.depth) as event from closure c join deltas d on d.sg = c.anc group by c.room, c.sg, d.typ, d.skey",
    "idx": "select sg, room, row_number() over (partition by room order by sg) - 1 as idx, count(*) over (partition by room) as n from ev",
    "runs": """select room, event, min(idx) as start_index, case when max(idx) + 1 < max(n) then max(idx) + 1 end as end_index from (
               select s.room, s.event, i.idx, i.n, i.idx - row_number() over (partition by s.room, s.event order by i.idx) as run
               from (select distinct room, sg, event from state) s join idx i using (room, sg)) group by room, event, run""",
    "named": """select r.room, r.event, r.start_index, r.end_index, a.sg as start_sg_id, b.sg as end_sg_id
               from runs r join idx a on a.room = r.room and a.idx = r.start_index left join idx b on b.room = r.room and b.idx = r.end_index""",
    "points": "select distinct room, point from (select room, unnest([n * 1 // 4, n * 2 // 4, n * 3 // 4]) as point from (select room, max(n) as n from idx group by room))",
    "sg_points": "select p.room, i.sg as point from points p join idx i on i.room = p.room and i.idx = p.point",
    "churn": """select i.room, i.sg, coalesce(a.c, 0) as add_count, coalesce(g.c, 0) as gone_count from idx i
               left join (select room, start_index, count(*) as c from runs group by 1, 2) a on a.room = i.room and a.start_index = i.idx
               left join (select room, end_index, count(*) as c from runs where end_index is not null group by 1, 2) g on g.room = i.room and g.end_index = i.idx""",
    "perms": f"select unnest(range(128)) as p, unnest({_LISTS[0]}) as a, unnest({_LISTS[1]}) as b",
    "doc_members": "select distinct lang as room, doc_id as sg, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as member from documents",
    "doc_hashes": _signatures("doc_members"),
    "ev_members": "select room, sg, event as member from state",
    "signed": _signatures("ev_members"),
    "hashes": "select s.*, c.add_count, c.gone_count from signed s join churn c using (room, sg)",
    "sections": """select room, section, min(sg) as start_sg, max(sg) as end_sg from (
               select room, sg, cast(sum(starts) over (partition by room order by sg) - 1 as bigint) as section from (
               select room, sg, case when row_number() over (partition by room order by sg) = 1 or add_count + gone_count > 10 then 1 else 0 end as starts
               from hashes)) group by room, section""",
    "start_probes": "select * from hashes where (room, sg) in (select (room, start_sg) from sections)",
    "end_probes": "select * from hashes where (room, sg) in (select (room, end_sg) from sections)",
    "past_bands": _best("start_probes", "lsh_bands", "<"),
    "future_bands": _best("end_probes", "lsh_bands", ">"),
    "past_missed": "select * from start_probes where (room, sg) not in (select (room, probe) from past_bands)",
    "future_missed": "select * from end_probes where (room, sg) not in (select (room, probe) from future_bands)",
    "past": "select * from past_bands union all" + _best("past_missed", "minhash", "<"),
    "future": "select * from future_bands union all" + _best("future_missed", "minhash", ">"),
    "segs": """select room, sg, cast(sum(case when first then 0 when opens or cut_before then 1 else 0 end) over (partition by room order by sg) as bigint) as segment from (
               select room, sg, row_number() over w = 1 as first, (room, sg) in (select (room, match) from future) as opens,
                 coalesce(lag((room, sg) in (select (room, end_sg) from sections union select (room, match) from past)) over w, false) as cut_before
               from hashes window w as (partition by room order by sg))""",
    "ends": "select room, segment, min(sg) as start_sg, max(sg) as end_sg from segs group by room, segment",
    "found": """select room, probe as start, arg_max(sg, [similarity, sg]) as branch from (
               select p.room, p.sg as probe, c.sg, len(list_filter(list_zip(c.minhash, p.minhash), lambda z: z[1] = z[2])) / 128 as similarity
               from hashes p join hashes c on p.room = c.room and c.sg < p.sg and p.add_count + p.gone_count > 5 and list_has_any(c.lsh_bands, p.lsh_bands)
               where len(list_filter(c.lsh_bands, lambda x: list_contains(p.lsh_bands, x))) >= 8) group by room, probe""",
    "falling": "select room, sg, -segment as ordering from segs",
    "dist": """select a.room, a.segment as i, b.segment as j, case when a.segment = b.segment then 0
          when len(list_intersect(x.lsh_bands, y.lsh_bands)) > 0 then (16 - len(list_intersect(x.lsh_bands, y.lsh_bands))) * 8
          else 128 - len(list_intersect(x.minhash, y.minhash)) end as distance
        from ends a join ends b on a.room = b.room join hashes x on x.room = a.room and x.sg = a.end_sg join hashes y on y.room = b.room and y.sg = b.start_sg""",
    "near": "select room, i, list(j order by distance, j) as js from dist group by room, i",
    "hops": """select room, [0::bigint] as path from near where i = 0 union all
               select h.room, list_append(h.path, list_filter(n.js, lambda x: not list_contains(h.path, x))[1]) from hops h join near n on n.room = h.room and n.i = h.path[-1]
               where len(h.path) < len(n.js)""",
    "greedy": _solved("hops"),
    "greedy_idx": """select room, sg, row_number() over (partition by room order by rank, sg) - 1 as idx, count(*) over (partition by room) as n
               from segs join greedy using (room, segment)""",
    "greedy_runs": """select room, event, min(idx) as start_index, case when max(idx) + 1 < max(n) then max(idx) + 1 end as end_index from (
               select s.room, s.event, i.idx, i.n, i.idx - row_number() over (partition by s.room, s.event order by i.idx) as run
               from (select distinct room, sg, event from state) s join greedy_idx i using (room, sg)) group by room, event, run""",
    "sym": "select a.room, a.i, a.j, least(a.distance, b.distance) as w from dist a join dist b on a.room = b.room and a.i = b.j and a.j = b.i where a.i <> a.j",
    "prim": """select room, [0::bigint] as path, null::bigint as source from near where i = 0 union all
               select t.room, list_append(any_value(t.path), arg_min(s.j, [s.w, s.j, list_position(t.path, s.i)])), arg_min(s.i, [s.w, s.j, list_position(t.path, s.i)])
               from prim t join sym s on s.room = t.room and list_contains(t.path, s.i) and not list_contains(t.path, s.j) group by t.room""",
    "tree": "select p.room, p.source as a, p.path[-1] as b, s.w from prim p join sym s on s.room = p.room and s.i = p.source and s.j = p.path[-1]",
    "branchlets": "select room, a, b, w from tree union all select room, b, a, w from tree",
    "leaves": """select n.room, min(n.i) as leaf from near n left join (select room, a, count(*) as degree from branchlets group by room, a) d on d.room = n.room and d.a = n.i
               where coalesce(d.degree, 0) <= 1 group by n.room""",
    "walk": """select room, leaf as node, null::bigint as parent, 0 as depth, [0::bigint] as way from leaves union all
               select k.room, b.b, k.node, k.depth + 1, list_concat(k.way, [b.w, b.b]) from walk k join branchlets b on b.room = k.room and b.a = k.node and b.b is distinct from k.parent""",
    "moves": """select room, start, coalesce(lead(start) over w, 9223372036854775807) as stop, branch, row_number() over w as k from found window w as (partition by room order by start)""",
    "moved": """select room, 0::bigint as k, list(sg order by sg) as nodes from hashes group by room union all
               select room, k, list_concat(list_concat(rest[1:list_position(rest, branch)], list_filter(nodes, lambda x: x >= start and x < stop)), rest[list_position(rest, branch) + 1:]) from (
                 select m.room, m.k, v.nodes, m.start, m.stop, m.branch, list_filter(v.nodes, lambda x: x < m.start or x >= m.stop) as rest
                 from moved v join moves m on m.room = v.room and m.k = v.k + 1)""",
    "lines": """select room, sg, 0 as depth, [sg] as way from ev where sg not in (select sg from edges) union all
               select e.room, e.sg, l.depth + 1, list_append(l.way, e.sg) from lines l join edges e on e.room = l.room and e.prev = l.sg""",
    "bands_steps": _hilbert_steps("bands", 16, "list_transform(lsh_bands, lambda v: v % 256)"),
    "folded_steps": _hilbert_steps("folded", 8, "list_transform(range(8), lambda k: cast(list_sum(minhash[16 * k + 1:16 * k + 16]) as bigint) % 256)"),
    "painted": """select room, sg, list_transform(lsh_bands, lambda x: lpad(lower(to_hex(x & 4294967295)), 8, '0')) as words from doc_hashes""",
    "order_lines": "select distinct o_custkey, l_orderkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey",
    "reach": "select sg as node, sg as other from ev union select r.node, case when e.sg = r.other then e.prev else e.sg end from reach r join edges e on e.sg = r.other or e.prev = r.other",
    "turns": "select cast(conv_id as varchar) as room, conv_id, conv_id * 1000 + turn as sg, turn, role from conversations",
}
_RECURSIVE = ("closure", "reach", "hops", "prim", "walk", "moved", "lines", "bands_steps", "folded_steps")
_HEX = "lpad(lower(to_hex(x & 4294967295)), 8, '0')"

FINAL = {
    "sg_dag_join": "select room, sg, prev from edges",
    "dag_nodes": "select room, sg from edges union select room, prev from edges",
    "delta_rows": "select room, sg, typ as type, skey as state_key, eid as event from deltas",
    "ancestor_closure": "select * from closure",
    "resolve_state": "select room, sg, typ as type, skey as state_key, event from state",
    "resolve_state_by_id": "select c.room, c.sg, d.typ as type, d.skey as state_key, arg_max(d.eid, c.anc) as event from closure c join deltas d on d.sg = c.anc group by c.room, c.sg, d.typ, d.skey",
    "interval_encode": "select * from named",
    "interval_decode": "select distinct room, sg, event from state",
    "event_enrichment": "select r.*, d.type, d.state_key from runs r join (select room, eid, min(typ) as type, min(skey) as state_key from deltas group by room, eid) d on d.room = r.room and d.eid = r.event",
    "current_state": "select room, event, start_index from runs where end_index is null",
    "asof_index": "select p.room, p.point, r.event from points p join runs r on r.room = p.room and start_index <= point and (end_index is null or end_index > point)",
    "asof_state": "select p.room, p.point, r.event from sg_points p join named r on r.room = p.room and start_sg_id <= point and (end_sg_id is null or end_sg_id > point)",
    "asof_state_union": """select p.room, p.point, r.event from sg_points p join named r on r.room = p.room and start_sg_id <= point and end_sg_id is null union all
        select p.room, p.point, r.event from sg_points p join named r on r.room = p.room and start_sg_id <= point and end_sg_id > point""",
    "asof_recursive": "select p.room, p.point, s.event from sg_points p join state s on s.room = p.room and s.sg = p.point",
    "churn_counts": "select * from churn",
    "churn_carried": """select room, sg, add_count, cast(sum(gone_count) over (partition by room, g order by sg) as bigint) as gone_count from (
        select *, coalesce(sum((add_count > 0)::int) over (partition by room order by sg rows between unbounded preceding and 1 preceding), 0) as g from churn)
        qualify add_count > 0""",
    "chunks": "select e.room, e.sg, min(r.other) as chunk from ev e join reach r on r.node = e.sg group by e.room, e.sg",
    "topo_depth": "select room, sg, max(depth) as depth from closure group by room, sg",
    "minhash_signature": "select room, sg, array_to_string(minhash, ',') as minhash from doc_hashes",
    "lsh_bands": "select room, sg, array_to_string(lsh_bands, ',') as lsh_bands from doc_hashes",
    "hex_bands": f"select room, sg, array_to_string(list_transform(lsh_bands, lambda x: {_HEX}), ' ') as hex from hashes",
    "doc_minhash_neighbors": f"select room, probe, match, round(similarity, 6) as similarity from ({_best('doc_hashes', 'lsh_bands', '<', 'doc_hashes')})",
    "jaccard_pairs": """select a.room, a.sg as a, b.sg as b, round(len(list_filter(list_zip(a.minhash, b.minhash), lambda z: z[1] = z[2])) / 128, 6) as jaccard
        from doc_hashes a join doc_hashes b on a.room = b.room and a.sg < b.sg and list_has_any(a.lsh_bands, b.lsh_bands)""",
    "band_overlap_k": """select * from (select p.room, p.sg as probe, c.sg, len(list_filter(c.lsh_bands, lambda x: list_contains(p.lsh_bands, x))) as shared
        from start_probes p join hashes c on p.room = c.room and c.sg < p.sg) where shared >= 8""",
    "sections": "select * from sections",
    "branch_points_past": "select room, probe, match, round(similarity, 6) as similarity from past_bands",
    "branch_points_future": "select room, probe, match, round(similarity, 6) as similarity from future_bands",
    "branch_points_fallback": "select room, probe, match, round(similarity, 6) as similarity from past",
    "segment_labels": "select * from segs",
    "segment_distance": "select * from dist",
    "order_greedy": "select s.room, s.sg, g.rank as ordering from segs s join greedy g using (room, segment)",
    "reordered_intervals": """select r.room, r.event, r.start_index, r.end_index, a.sg as start_sg_id, b.sg as end_sg_id
        from greedy_runs r join greedy_idx a on a.room = r.room and a.idx = r.start_index left join greedy_idx b on b.room = r.room and b.idx = r.end_index""",
    "order_mst": "select s.room, s.sg, w.rank as ordering from segs s join (select room, node, row_number() over (partition by room order by depth, way) - 1 as rank from walk) w on w.room = s.room and w.node = s.segment",
    "order_dfs": "select s.room, s.sg, w.rank as ordering from segs s join (select room, node, row_number() over (partition by room order by way) - 1 as rank from walk) w on w.room = s.room and w.node = s.segment",
    "order_branches": "select room, unnest(nodes) as sg, generate_subscripts(nodes, 1) - 1 as ordering from (select room, arg_max(nodes, k) as nodes from moved group by room)",
    "order_topological": "select room, sg, row_number() over (partition by room order by way[1], depth, way) - 1 as ordering from lines",
    "order_hilbert": _hilbert("bands", 16),
    "order_hilbert_folded": _hilbert("folded", 8),
    "colorize": """select room, sg, array_to_string(list_transform(words, lambda x: chr(27) || '[48;2;' || ('0x' || x[1:2])::int || ';' || ('0x' || x[3:4])::int || ';' || ('0x' || x[5:6])::int || 'm'
        || chr(27) || '[38;2;' || case when (0.299::double * ('0x' || x[1:2])::int + 0.587::double * ('0x' || x[3:4])::int + 0.114::double * ('0x' || x[5:6])::int) / 255 > 0.5 then '0;0;0' else '255;255;255' end
        || 'm' || x || chr(27) || '[0m'), ' ') as painted from painted""",
    "asof_tables": "select p.room, p.point, s.event from sg_points p join state s on s.room = p.room and s.sg = p.point",
    "asof_reordered": "select distinct p.room, p.point, s.event from sg_points p join state s on s.room = p.room and s.sg = p.point",
    "index_non_empty": "select room, sg, row_number() over (partition by room order by sg) - 1 as idx from (select distinct room, sg from deltas where sg % 7 <> 0)",
    "ordered_lookup": """select d.room, i.idx, d.sg, d.typ as type, d.skey as state_key, d.eid as event
        from deltas d join (select room, sg, row_number() over (partition by room order by ordering, sg) - 1 as idx from falling) i on i.room = d.room and i.sg = d.sg""",
    "band_distance": """select room, sg, next_sg, len(lsh_bands) - len(list_intersect(lsh_bands, next)) as distance from (
        select room, sg, lsh_bands, lead(sg) over w as next_sg, lead(lsh_bands) over w as next from hashes window w as (partition by room order by sg)) where next_sg is not null""",
    "branch_detection": "select * from found",
    "branch_fill": """select h.room, h.sg, coalesce(last_value(f.branch ignore nulls) over (partition by h.room order by h.sg), min(h.sg) over (partition by h.room)) as branch
        from hashes h left join found f on f.room = h.room and f.start = h.sg""",
    "range_assign": "select h.room, h.sg, e.segment from hashes h join ends e on e.room = h.room and h.sg between e.start_sg and e.end_sg",
    "ordering_writeback": """select a.room, a.sg, b.sg as ordering from (select *, row_number() over (partition by room order by ordering, sg) as k from falling) a
        join (select room, sg, row_number() over (partition by room order by sg) as k from falling) b on a.room = b.room and a.k = b.k""",
    "order_inversions": "select * from (select room, sg, sg - lag(sg) over (partition by room order by ordering, sg) as diff from falling) where diff < 0",
    "flipflop_hotspots": "select room, start_index, count(*) as runs from runs group by room, start_index having count(*) > 10",
    "dag_gaps": "select n.room, n.start_sg_id, e.prev from (select distinct room, start_sg_id from named) n left join edges e on e.room = n.room and e.sg = n.start_sg_id",
    "compression_summary": """select d.room, d.delta_rows, m.member_rows, r.events, r.intervals, round(r.intervals / d.delta_rows, 6) as ratio
        from (select room, count(*) as delta_rows from deltas group by room) d join (select room, count(*) as member_rows from state group by room) m using (room)
        join (select room, count(distinct event) as events, count(*) as intervals from runs group by room) r using (room)""",
    "basket_intervals": """select room, event, min(idx) as start_index, case when max(idx) + 1 < max(n) then max(idx) + 1 end as end_index from (
        select cast(l.o_custkey as varchar) as room, l.l_partkey as event, i.idx, i.n, i.idx - row_number() over (partition by l.o_custkey, l.l_partkey order by i.idx) as run
        from order_lines l join (select o_custkey, l_orderkey, row_number() over (partition by o_custkey order by l_orderkey) - 1 as idx, count(*) over (partition by o_custkey) as n
          from (select distinct o_custkey, l_orderkey from order_lines)) i using (o_custkey, l_orderkey)) group by room, event, run""",
    "conversation_state": """select a.room, a.sg, 'turn' as type, b.role as state_key, max(b.sg) as event from turns a join turns b on a.conv_id = b.conv_id and b.turn <= a.turn
        group by a.room, a.sg, b.role""",
}


def _with(final: str) -> str:
    """``final`` behind the expressions it needs, each after those it needs itself."""
    needed: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in needed and re.search(rf"\b(from|join)\s+{name}\b", sql):
                visit(CTES[name], name)
                needed.append(name)

    visit(final)
    if not needed:
        return final
    body = ",\n".join(f"{n} as {'' if n in _RECURSIVE else 'materialized '}({CTES[n]})" for n in needed)
    return f"with recursive {body}\n{final}"


ORACLE_SQL = {name: _with(sql) for name, sql in FINAL.items()}
