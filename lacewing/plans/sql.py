"""DuckDB building blocks for the queries' independent SQL."""

G1 = """g1 as (select distinct o.o_custkey graph_id, a.l_suppkey src, b.l_suppkey dst
  from orders o join lineitem a on a.l_orderkey = o.o_orderkey join lineitem b on b.l_orderkey = o.o_orderkey and a.l_suppkey < b.l_suppkey)"""

ROLE1 = "r1 as (select c_custkey graph_id, case when c_mktsegment = 'BUILDING' then 'pos' else 'neg' end as role, c_mktsegment as class from customer)"

G2 = """n2 as (select user_id * 100 + cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 7) as bigint) g,
  concat(event_type, cast(cast(floor(value / 100) as int) as varchar)) n, ts, event_id from events),
e2 as (select g, n a, lead(n) over (partition by g order by ts, event_id) b from n2),
g2 as (select distinct g graph_id, least(a, b) src, greatest(a, b) dst from e2 where b is not null and a <> b)"""


def sym(g: str) -> str:
    return f"s as (select graph_id, src a, dst b from {g} union all select graph_id, dst, src from {g})"


TRI = """tri as (select x.graph_id, x.src a, x.dst b, y.dst c from {g} x join {g} y on x.graph_id = y.graph_id and x.dst = y.src
  join {g} z on z.graph_id = x.graph_id and z.src = x.src and z.dst = y.dst)"""

#: Connected sets of three and of four nodes; needs s.
K3 = "k3 as (select distinct x.graph_id, list_sort([x.a, x.b, y.b]) nodes from s x join s y on x.graph_id = y.graph_id and x.b = y.a and y.b <> x.a)"
K4 = """k4 as (select distinct t.graph_id, list_sort(list_append(nodes, s.b)) nodes from (select graph_id, nodes, unnest(nodes) n from k3) t
  join s on s.graph_id = t.graph_id and s.a = t.n where not list_contains(nodes, s.b))"""


def profile(k: str) -> str:
    """ind, deg, tr and prof (graph_id, nodes, a, d, t) of the sets in k."""
    return f"""ind as (select k.graph_id, k.nodes, s.a, s.b from (select graph_id, nodes, unnest(nodes) n from {k}) k join s on k.graph_id = s.graph_id and k.n = s.a and list_contains(k.nodes, s.b)),
deg as (select graph_id, nodes, a, count(*) d from ind group by all),
tr as (select x.graph_id, x.nodes, x.a, count(*) // 2 t from ind x join ind y on x.graph_id = y.graph_id and x.nodes = y.nodes and x.a = y.a and x.b <> y.b
  join s on s.graph_id = x.graph_id and s.a = x.b and s.b = y.b group by all),
prof as (select deg.graph_id, deg.nodes, deg.a, d, coalesce(t, 0) t from deg left join tr on deg.graph_id = tr.graph_id and deg.nodes = tr.nodes and deg.a = tr.a)"""


def wl_rounds(iterations: int) -> str:
    """l0, l1, ... (graph_id, nodes, a, l): labels after each round, from induced degrees; al: all of them by round r; needs ind and deg."""
    parts = ["l0 as (select graph_id, nodes, a, cast(d as varchar) l from deg)"]
    for i in range(iterations):
        parts.append(f"l{i + 1} as (select x.graph_id, x.nodes, x.a, md5(x.l || '|' || string_agg(y.l, ',' order by y.l)) l from l{i} x join ind on ind.graph_id = x.graph_id and ind.nodes = x.nodes and ind.a = x.a join l{i} y on y.graph_id = x.graph_id and y.nodes = x.nodes and y.a = ind.b group by x.graph_id, x.nodes, x.a, x.l)")
    return ", ".join(parts) + ", al as (" + " union all ".join(f"select *, {i} r from l{i}" for i in range(iterations + 1)) + ")"


CERT = "cert as (select graph_id, nodes, string_agg(d || ':' || t, ',' order by d, t) cert from prof group by all)"


def gstat(counts: str) -> str:
    """score from a table of bucket, r_pos, r_neg."""
    return f"""tot as (select sum(r_pos) tp, greatest(sum(r_neg), 1) tn from {counts}),
sc as (select bucket, r_pos, r_neg, 2 * ((case when r_pos > 0 then r_pos * ln(r_pos / ((r_pos + r_neg) * (tp / (tp + tn)))) else 0 end)
  + (case when r_neg > 0 then r_neg * ln(r_neg / ((r_pos + r_neg) * (1 - tp / (tp + tn)))) else 0 end)) score
  from {counts}, (select cast(tp as double) tp, cast(tn as double) tn from tot) where r_pos > 0)"""
