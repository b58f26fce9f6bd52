"""Nearest vectors and densities over all references, in blocks, against brute force."""

import numpy as np
import pytest

from lacewing.operators import vectors


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(300, 4))
    z[200:230] = z[7]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "id long, z array<double>")
    return rows, np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))


def test_every_reference_counts(monkeypatch, table):
    monkeypatch.setattr(vectors, "REFERENCES", 100)  # less than the rows, as 10,000 is for a large table
    monkeypatch.setattr(vectors, "BLOCK", 64, raising=False)
    rows, d = table
    ids = np.arange(300)
    got = {(r.id, r.rank): (r.other, r.dist) for r in vectors.nearest_rows(rows, rows, 7, 3).collect()}
    assert len(got) == 900
    for i in range(300):
        order = np.lexsort((ids, d[i]))
        assert [got[i, k + 1] for k in (0, 3, 6)] == [(order[k], pytest.approx(d[i][order[k]])) for k in (0, 3, 6)]
    stats = vectors.distance_stats(rows, rows, 2).collect()
    assert len(stats) == 300
    for r in stats:
        assert (r.nearest, r.kth, r.n) == (0.0, pytest.approx(np.sort(d[r.id])[1]), 300)
        assert r.kde == pytest.approx(np.exp(-d[r.id] ** 2 / 2).mean() / (2 * np.pi) ** 2)


def test_cosine_of_every_pair(monkeypatch, table):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rows, _ = table
    z = np.array([r.z for r in rows.orderBy("id").collect()])
    unit = z / np.sqrt((z**2).sum(1))[:, None]
    got = {(r.i, r.j): r.sim for r in vectors.cosine_pairs(rows).collect()}
    assert got == {(i, j): pytest.approx(float(unit[i] @ unit[j])) for i in range(300) for j in range(i + 1, 300)}


def clustered(n, dim, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 8
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.3


@pytest.mark.parametrize("block", [16, 1024])
def test_cells_rule_out_most_pairs_and_lose_none(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    z = clustered(900, 6, 12)
    z[100:400] = z[3]  # a third of the rows are one vector
    z[500:520, 0] = z[500, 0]
    ids = np.random.default_rng(3).permutation(900)
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, z, strict=True)], "id long, z array<double>").repartition(5)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    got = {r.id: (r.others, r.dists) for r in vectors.nearest(rows, rows, 9).collect()}
    assert len(got) == 900
    for i in range(900):
        order = np.lexsort((ids, np.round(d[i], 12)))[:9]
        others, dists = got[int(ids[i])]
        assert others == ids[order].tolist() and np.allclose(dists, d[i][order])
    seen, every = vectors.search_cost(rows, rows, 9)
    assert seen < 0.35 * every
    sums = {r.id: r.total for r in vectors.kernel_sums(rows, rows, 0.5).collect()}
    assert all(sums[int(i)] == pytest.approx(np.exp(-d[j] ** 2 / 0.5).sum(), rel=1e-9) for j, i in enumerate(ids))


def test_plan_has_no_cross_join(spark, table, capsys):
    rows, _ = table
    vectors.nearest(rows, rows, 3).explain()
    vectors.kernel_sums(rows, rows).explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_few_and_no_references(spark, table):
    rows, d = table
    few = rows.filter("id < 3")
    got = {r.id: r.others for r in vectors.nearest(rows, few, 5).collect()}
    assert len(got) == 300 and all(sorted(o) == [0, 1, 2] for o in got.values())
    none = rows.filter("id < 0")
    assert {len(r.others) for r in vectors.nearest(rows, none, 2).collect()} == {0} and vectors.nearest(none, rows, 2).count() == 0


def test_queries_meet_cells_in_groups(spark, monkeypatch):
    """Where no cell is ruled out, rows are made for groups and cells, not for queries and cells."""
    monkeypatch.setattr(vectors, "QUERIES", 100)
    monkeypatch.setattr(vectors, "CHUNK", 3)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    z = np.random.default_rng(4).normal(size=(500, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "id long, z array<double>")
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    got = {r.id: r.others for r in vectors.nearest(rows, rows, 4).collect()}
    assert got == {i: np.lexsort((np.arange(500), d[i]))[:4].tolist() for i in range(500)}
    sums = {r.id: r.total for r in vectors.kernel_sums(rows, rows).collect()}
    assert all(sums[i] == pytest.approx(np.exp(-d[i] ** 2 / 2).sum(), rel=1e-9) for i in range(500))
    _, [_, (queries, choose)], cells = vectors._search(vectors._distinct(rows)[1], rows, 4)
    visits = vectors._visits(queries, cells, choose, "id").count()
    assert vectors._visits(queries, cells, choose, "group").distinct().count() <= 5 * len(cells.pivots) < visits / 5
