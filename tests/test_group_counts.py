"""Counts of graphs made of groups: one shuffle of the groups' rows, no edge written."""

import itertools
import math

import duckdb
import numpy as np
import pytest

from lacewing.operators import graphs
from lacewing.plans import registry

SF = "/root/testdata/sf0.001"


def brute(rows):
    tied = {}
    for _, some in itertools.groupby(sorted(r for r in rows if None not in r), key=lambda r: r[:2]):
        some = list(some)
        tied.setdefault(some[0][0], set()).update(itertools.combinations(sorted({r[2] for r in some}), 2))
    out = {}
    for g, edges in tied.items():
        nodes = sorted({v for e in edges for v in e})
        whole = lambda k, nodes=nodes, edges=edges: sum(set(itertools.combinations(c, 2)) <= edges for c in itertools.combinations(nodes, k))
        if edges:
            out[g] = (sum(math.comb(sum(v in e for e in edges), 2) for v in nodes), whole(3), whole(4))
    return out


@pytest.mark.parametrize("nodes, ties", [(1024, 1 << 16), (7, 1 << 16), (1024, 25)])
def test_counts_equal_brute_force(spark, monkeypatch, nodes, ties):
    monkeypatch.setattr(graphs, "NODES", nodes)
    monkeypatch.setattr(graphs, "TIES", ties)
    rng = np.random.default_rng(2)
    rows = [(int(g), int(100 * g + c), int(v)) for g in range(12) for c in range(g // 2 + 1) for v in rng.integers(0, 9, rng.integers(1, 6))]
    rows += [*rows[:9], (None, 1, 2), (None, 1, 3), (3, 300, None), (4, None, 1), (4, None, 2), (50, 1, 7), (50, 1, 7), (51, 1, 7)]
    counts, larger = graphs.group_counts(spark.createDataFrame(rows, "graph_id long, group long, node long"))
    got = {r.graph_id: (r.w, r.t, r.q) for r in counts.collect()}
    rest = {r.graph_id for r in larger.collect()} if larger is not None else set()
    want = brute(rows)
    assert not rest & got.keys() and (got.keys() | rest) == want.keys()
    assert got == {g: x for g, x in want.items() if g in got}
    assert bool(rest) == ((nodes, ties) != (1024, 1 << 16)) and got


@pytest.mark.parametrize("nodes", [8, 1024])
def test_queries_equal_sql_for_larger_graphs_too(spark, monkeypatch, nodes):
    monkeypatch.setattr(graphs, "NODES", nodes)
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for q in ("g1_clique4_count", "g1_bucket_counts_k3"):
        got = registry.QUERIES[q](spark, SF)
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(registry.ORACLE_SQL[q]).fetchall())
