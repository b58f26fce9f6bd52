"""Vectors of subgraphs: hash planes, discriminants, densities and kernels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Reference vectors of a sample, where one is asked for; chosen by hash.
REFERENCES = 10_000
#: Vectors in a block, about.
BLOCK = 1024
#: Queries that a task holds at a time, and blocks of references that it meets them with, about.
QUERIES, CHUNK = 8192, 64
#: Pivots at most; their vectors and a few numbers about each travel to every task.
PIVOTS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def fixed_planes(n: int, dim: int) -> list[list[float]]:
    """Planes of small integers from -3 to 3, the same in any engine."""
    return [[float((i * 31 + j * 17 + i * j) % 7 - 3) for j in range(dim)] for i in range(n)]


def simhash(z: Column, planes: list[list[float]]) -> Column:
    """One character a plane: 1 where the projection is above 0."""
    return F.concat(*[F.when(dot(z, F.array(*map(F.lit, p))) > 0, "1").otherwise("0") for p in planes])


def moments(rows: DataFrame, dim: int) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """role -> (n, sum of z, sum of z z') in one pass; the driver gets dim * dim numbers a role and task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            roles = b.column(0).dictionary_encode()
            names, at = roles.dictionary.to_pylist(), roles.indices.to_numpy(zero_copy_only=False)
            z = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            for i, r in enumerate(names):
                own = z[at == i]
                x = np.hstack([np.ones((len(own), 1)), own])
                total[r] = total.get(r, 0) + x.T @ x
        for r, m in total.items():
            k = np.arange(m.size)
            yield pa.RecordBatch.from_arrays([pa.array([r] * m.size), pa.array(k), pa.array(m.ravel())], names=["role", "k", "v"])

    sums = rows.select("role", "z").mapInArrow(partial, "role string, k long, v double").groupBy("role", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.role, np.zeros((dim + 1) ** 2))[r.k] = r.v
    full = {k: v.reshape(dim + 1, dim + 1) for k, v in out.items()}
    return {k: (int(m[0, 0]), m[0, 1:], m[1:, 1:]) for k, m in full.items()}


def _oriented(v: np.ndarray) -> np.ndarray:
    return v if v[np.argmax(np.abs(v))] > 0 else -v


def lda_planes(rows: DataFrame, dim: int, hash_dim: int) -> tuple[np.ndarray, float]:
    """(planes, separation): the discriminant of pos against neg, then principal axes of pos without it.

    Everything comes from the classes' moments; no second pass over the rows.
    """
    return _lda(moments(rows, dim), dim, hash_dim)


def _lda(m: dict[str, tuple], dim: int, hash_dim: int) -> tuple[np.ndarray, float]:
    (n1, s1, q1), (n0, s0, q0) = m["pos"], m["neg"]
    mu1, mu0 = s1 / n1, s0 / n0
    within = q1 - n1 * np.outer(mu1, mu1) + q0 - n0 * np.outer(mu0, mu0) + 1e-6 * np.eye(dim)
    w = np.linalg.solve(within, mu1 - mu0)
    w /= np.linalg.norm(w)
    spread = lambda n, q, mu: math.sqrt(max(0.0, float(w @ (q / n - np.outer(mu, mu)) @ w)))
    separation = float(w @ (mu1 - mu0)) / (spread(n1, q1, mu1) + spread(n0, q0, mu0) + 1e-8)
    k = min(hash_dim - 1, n1 - 1, dim - 1)
    rest = np.eye(dim) - np.outer(w, w)
    _, axes = np.linalg.eigh(rest @ (q1 / n1 - np.outer(mu1, mu1)) @ rest)
    return np.vstack([w, *[_oriented(axes[:, -1 - i]) for i in range(k)]]), separation


def planes_by_fold(rows: DataFrame, dim: int, hash_dim: int) -> dict[int, np.ndarray]:
    """fold -> planes fitted on the rows of all other folds; zeros where a role is missing there.

    ``rows`` has fold, role and z; roles other than pos and neg don't count. One
    pass collects each fold's moments, and a fold's complement is their sum.
    """
    used = rows.filter(F.col("role").isin("pos", "neg"))
    own = moments(used.select(F.concat_ws("|", "fold", "role").alias("role"), "z"), dim)
    out = {}
    for fold in sorted({int(k.split("|")[0]) for k in own}):
        parts: dict[str, list] = {"pos": [], "neg": []}
        for k, m in own.items():
            f, role = k.split("|")
            if int(f) != fold:
                parts[role].append(m)
        if all(parts.values()):
            total = {r: tuple(sum(x[i] for x in ms) for i in range(3)) for r, ms in parts.items()}
            out[fold] = _lda(total, dim, hash_dim)[0]
        else:
            out[fold] = np.zeros((hash_dim, dim))
    return out


def pca_planes(rows: DataFrame, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes, share of variance) over all rows."""
    m = moments(rows.select(F.lit("all").alias("role"), "z"), dim)["all"]
    cov = m[2] / m[0] - np.outer(m[1] / m[0], m[1] / m[0])
    values, axes = np.linalg.eigh(cov)
    k = min(n, m[0] - 1, dim - 1)
    return np.vstack([_oriented(axes[:, -1 - i]) for i in range(k)]), values[::-1][:k] / values.sum()


def tree_leaves(rows: DataFrame, dim: int, depth: int = 5, min_leaf: int = 20) -> DataFrame:
    """rows with leaf: the leaf of a decision tree for role on z."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("features", array_to_vector(F.col("z").cast("array<double>"))).withColumn("y", (F.col("role") == "pos").cast("double"))
    model = DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=depth, minInstancesPerNode=min_leaf, leafCol="leaf", seed=42).fit(data)
    return model.transform(data).withColumn("leaf", F.col("leaf").cast("int")).select(*rows.columns, "leaf")


def references(rows: DataFrame, most: int = REFERENCES) -> DataFrame:
    """A sample of ``most`` reference vectors at most, those with the smallest hash of their id; only for callers that ask for one."""
    return rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)


def _packed_blocks(rows: DataFrame, block: str, ids: str, z: str) -> DataFrame:
    """The rows in blocks of about BLOCK: number of the block, ids, vectors end to end."""
    rows = rows.select("id", F.col("z").cast("array<double>").alias("z"))
    blocks = max(1, -(-rows.count() // BLOCK))
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(block)).agg(F.sort_array(F.collect_list(F.struct("id", "z"))).alias("x"))
    return packed.select(block, F.col("x.id").alias(ids), F.flatten("x.z").alias(z))


def _least(distances: np.ndarray, others: np.ndarray, owner: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners its k least distances, and whose they are; ties by id. Every owner has k at least."""
    order = np.lexsort((others, distances, owner))
    pick = order[np.searchsorted(owner[order], np.arange(n))[:, None] + np.arange(k)]
    return distances[pick], others[pick]


def _nearest_in_block(q: np.ndarray, r: np.ndarray, ids: np.ndarray, own: np.ndarray, most: np.ndarray, dists: np.ndarray, others: np.ndarray) -> None:
    """Brings the nearest so far (``dists`` and ``others``, k columns) of the rows ``own`` of q up to date with the rows of r that are no farther than ``most``.

    Products of matrices choose candidates, with room for their rounding; the
    distances come from differences.
    """
    k = dists.shape[1]
    r2 = (r**2).sum(1)
    for at in range(0, len(own), BLOCK):
        mine = own[at : at + BLOCK]
        x = q[mine]
        x2 = (x**2).sum(1)
        d2 = np.maximum(0.0, x2[:, None] + r2 - 2 * x @ r.T)
        limit = np.minimum(most[mine], dists[mine, -1]) ** 2
        if k < len(r) and np.isinf(limit).any():
            limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d2 <= (limit + 1e-11 * (x2 + r2.max()))[:, None])
        if not len(i):
            continue
        touched, owner = np.unique(i, return_inverse=True)
        rows = mine[touched]
        d = np.concatenate([dists[rows].ravel(), np.sqrt(((x[i] - r[j]) ** 2).sum(1))])
        o = np.concatenate([others[rows].ravel(), ids[j]])
        dists[rows], others[rows] = _least(d, o, np.concatenate([np.repeat(np.arange(len(rows)), k), owner]), len(rows), k)


@dataclass(frozen=True)
class Cells:
    """References by their nearest pivot: tables of bounded size about the cells, and their vectors in blocks."""

    pivots: np.ndarray
    sizes: np.ndarray  # weight of each cell's references
    low: np.ndarray  # least and largest distance of them to the pivot
    high: np.ndarray
    numbers: list[int]  # blocks of each cell
    blocks: DataFrame  # cell, block, rid, r, w

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distances to the pivots, least and largest possible distances to a cell's references) of each row of q, by the triangle inequality."""
        d = _distances(q, self.pivots)
        slack = 1e-9 * (1 + d)
        return d, np.maximum(0.0, np.maximum(d - self.high, self.low - d) - slack), d + self.high + slack


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _in_cells(refs: DataFrame) -> Cells:
    """References (id, z, w) dealt to about the square root of their number of pivots, PIVOTS at most; a large cell has several blocks."""
    refs = cut(refs)
    n = refs.count()
    chosen = refs.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, math.isqrt(n) + 1)).select("z").collect()
    pivots = np.array([r.z for r in chosen], np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_rows(b.column(1)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["id", "z", "w", "cell", "d"])

    dealt = cut(refs.select("id", "z", "w").mapInArrow(deal, "id long, z array<double>, w long, cell int, d double"))
    sizes, low, high, rows = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots)), [0] * len(pivots)
    for r in dealt.groupBy("cell").agg(F.sum("w").alias("w"), F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).collect():
        sizes[r.cell], low[r.cell], high[r.cell], rows[r.cell] = r.w, r.low, r.high, r.n
    numbers = [-(-x // BLOCK) for x in rows]
    packed = _numbered(dealt, numbers, "block").groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("id", "z", "w"))).alias("x"))
    return Cells(pivots, sizes, low, high, numbers, cut(packed.select("cell", "block", F.col("x.id").alias("rid"), F.flatten("x.z").alias("r"), F.col("x.w").alias("w"))))


def _numbered(rows: DataFrame, numbers: list[int], name: str) -> DataFrame:
    """Adds the block of each row's id in its cell, of so many."""
    table = rows.sparkSession.createDataFrame(list(enumerate(numbers)), "cell int, _n int")  # a row a pivot
    return rows.join(F.broadcast(table), "cell").withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.greatest(F.lit(1), F.col("_n"))).cast("int")).drop("_n")


def _flags(cells: Cells, choose, q: np.ndarray, further: list[np.ndarray]) -> np.ndarray:
    """The cells that ``choose`` (vectors, further columns) gives each query, but empty ones."""
    parts = [choose(q[at : at + 256], *[x[at : at + 256] for x in further]) for at in range(0, len(q), 256)]
    return np.concatenate(parts) & (cells.sizes > 0)


def _grouped(queries: DataFrame, cells: Cells) -> DataFrame:
    """id, z, group: about QUERIES in a group; those of one cell, and of cells that follow each other along the pivots' main axis, go together."""
    pivots = cells.pivots

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_distances(_rows(b.column(1)), pivots).argmin(1).astype(np.int32))], names=["id", "z", "cell"])

    dealt = cut(queries.select("id", "z").mapInArrow(deal, "id long, z array<double>, cell int"))
    counts = {r.cell: r.n for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    axis = np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][0]
    starts, at = [], 0
    for c in np.argsort(pivots @ axis, kind="stable").tolist():
        if c in counts:
            starts.append((c, at, counts[c]))
            at += counts[c]
    table = queries.sparkSession.createDataFrame(starts, "cell int, _s long, _n long")
    place = F.col("_s") + F.pmod(F.xxhash64("id"), F.col("_n"))
    return dealt.join(F.broadcast(table), "cell").select("id", "z", F.floor(place / QUERIES).cast("int").alias("group"))


def _visits(queries: DataFrame, cells: Cells, choose, by: str) -> DataFrame:
    """by, cell: the cells that ``choose`` gives the queries (id, z, group, further columns) of each id or group; a group's can come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flags = _flags(cells, choose, _rows(b.column(1)), [c.to_numpy(zero_copy_only=False) for c in b.columns[3:]])
                i, c = np.nonzero(flags)
                found = np.unique(np.stack([b.column(by).to_numpy()[i].astype(np.int64), c], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32))], names=[by, "cell"])

    cells = replace(cells, blocks=None)  # what the tasks get
    return queries.mapInArrow(run, f"{by} long, cell int")


def _met(queries: DataFrame, cells: Cells, choose, work, schema: str) -> DataFrame:
    """The rows that ``work`` gives for groups of queries and chunks of the blocks that they visit.

    Queries travel once for each chunk, blocks once for each group that visits
    them; no row is made for a query and a cell. ``work`` gets the ids, vectors
    and further columns of the queries, their flags and the blocks.
    """
    needs = F.broadcast(cut(_visits(queries, cells, choose, "group").distinct()))  # at most a row a group and pivot
    chunks = max(1, -(-sum(cells.numbers) // CHUNK))
    chunk = F.pmod(F.xxhash64("cell", "block"), F.lit(chunks)).cast("int").alias("chunk")
    blocks = queries.sparkSession.createDataFrame([(c, n) for c, m in enumerate(cells.numbers) for n in range(m)], "cell int, block int")
    chosen = blocks.join(needs, "cell").select("group", chunk).distinct()
    left = queries.withColumn("group", F.col("group").cast("long")).join(F.broadcast(chosen), "group")
    right = cells.blocks.join(needs, "cell").select("group", chunk, "cell", "rid", "r", "w")
    further = [c for c in queries.columns if c not in ("id", "z", "group")]
    cells = replace(cells, blocks=None)

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        z, more = _rows(q["z"].combine_chunks()), [q[c].to_numpy() for c in further]
        each = (tuple(r[c][i].values.to_numpy(zero_copy_only=False) for c in ("rid", "r", "w")) for i in range(len(r)))
        blocks = ((c, rid, x.reshape(len(rid), -1), w) for c, (rid, x, w) in zip(r["cell"].to_pylist(), each, strict=True))
        return work(q["id"].to_numpy(), z, more, _flags(cells, choose, z, more), blocks)

    return left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInArrow(meet, schema)


def _first(rows: DataFrame, k: int) -> DataFrame:
    """id, other, dist: the k nearest of each id so far; tasks drop the rest before rows of an id meet."""
    order = Window.partitionBy("id").orderBy("dist", "other")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def _nearest_visited(queries: DataFrame, cells: Cells, choose, k: int) -> DataFrame:
    """id, other, dist: the k nearest of each id in each chunk of the cells that it visits, no farther than ``kth`` where there is one."""

    def work(ids: np.ndarray, q: np.ndarray, more: list[np.ndarray], flags: np.ndarray, blocks) -> pa.Table:
        most = more[0] if more else np.full(len(q), np.inf)
        dists, others = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for cell, rid, r, _ in blocks:
            _nearest_in_block(q, r, rid, np.flatnonzero(flags[:, cell]), most, dists, others)
        i, j = np.nonzero(np.isfinite(dists))
        return pa.table({"id": pa.array(ids[i]), "other": pa.array(others[i, j]), "dist": pa.array(dists[i, j])})

    return _met(queries, cells, choose, work, "id long, other long, dist double")


def _home(cells: Cells, k: int):
    """The nearest cells that hold k references together."""

    def choose(q: np.ndarray, *_) -> np.ndarray:
        d = cells.bounds(q)[0]
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out

    return choose


def _near(cells: Cells, k: int):
    """The other cells that may hold one as near as the k-th so far."""
    home = _home(cells, k)
    return lambda q, kth: (cells.bounds(q)[1] <= kth[:, None] * (1 + 1e-9)) & ~home(q)


def _search(queries: DataFrame, refs: DataFrame, k: int) -> tuple[DataFrame, list[tuple], Cells]:
    """(id, other, dist of the k nearest; the queries of the two passes and what they visit; the cells) of distinct query vectors."""
    # of references with one vector, the first k ids come before the others wherever they come
    same = Window.partitionBy("z").orderBy("id")
    cells = _in_cells(refs.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k).select("id", "z", F.lit(1).cast("long").alias("w")))
    bare = replace(cells, blocks=None)
    grouped = cut(_grouped(queries, cells))
    home, near = _home(bare, k), _near(bare, k)
    found = cut(_first(_nearest_visited(grouped, cells, home, k), k))
    # where fewer than k are there, no distance rules a cell out; then all are visited at home already
    bounded = cut(grouped.join(found.groupBy("id").agg(F.max("dist").alias("kth")), "id").select("id", "z", "group", "kth"))
    return _first(found.unionByName(_nearest_visited(bounded, cells, near, k)), k), [(grouped, home), (bounded, near)], cells


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, rep; id, z of the representatives): equal vectors are searched for once."""
    rows = cut(rows.select("id", F.col("z").cast("array<double>").alias("z")))
    reps = cut(rows.groupBy("z").agg(F.min("id").alias("rep")))
    return rows.join(reps, "z").select("id", "rep"), reps.select(F.col("rep").alias("id"), "z")


def nearest(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """id, dists and others: the k nearest of all references, ascending, ties by id.

    A query first visits the cells nearest to it that hold k references, then
    each other cell that the triangle inequality can't rule out at the k-th
    distance found. Groups of queries meet chunks of the cells' blocks by key;
    an id's candidates are cut to k in every task and never held together.
    """
    members, distinct = _distinct(queries)
    refs = refs.select("id", F.col("z").cast("array<double>").alias("z"))
    if not refs.limit(1).count():
        return members.select("id", F.array().cast("array<double>").alias("dists"), F.array().cast("array<bigint>").alias("others"))
    found = _search(distinct, refs, k)[0]
    lists = found.groupBy(F.col("id").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("dist", "other"))).alias("x"))  # k entries
    return members.join(lists, "rep").select("id", F.col("x.dist").alias("dists"), F.col("x.other").alias("others"))


def search_cost(queries: DataFrame, refs: DataFrame, k: int) -> tuple[int, int]:
    """(pairs of distinct vectors that ``nearest`` looks at, all pairs)."""
    _, distinct = _distinct(queries)
    refs = refs.select("id", F.col("z").cast("array<double>").alias("z"))
    _, passes, cells = _search(distinct, refs, k)
    visits = [_visits(q, cells, choose, "id") for q, choose in passes]
    seen = sum(r.n * int(cells.sizes[r.cell]) for v in visits for r in v.groupBy("cell").agg(F.count("*").alias("n")).collect())
    return seen, distinct.count() * int(cells.sizes.sum())


def kernel_sums(queries: DataFrame, refs: DataFrame, bandwidth: float = 1.0) -> DataFrame:
    """id, total: the sum of the Gaussian kernel over all references, to a relative 1e-12.

    Cells are summed exactly unless bounds say that all of those left out
    together don't matter at that precision.
    """
    members, distinct = _distinct(queries)
    weighted = refs.select("id", F.col("z").cast("array<double>").alias("z")).groupBy("z").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    cells = _in_cells(weighted.select("id", "z", "w"))
    bare = replace(cells, blocks=None)

    def matter(q: np.ndarray) -> np.ndarray:
        _, low, high = bare.bounds(q)
        kernel = lambda d: bare.sizes * np.exp(-(d**2) / (2 * bandwidth**2))
        return kernel(low) > 1e-12 / len(bare.pivots) * kernel(high).sum(1, keepdims=True)

    def work(ids: np.ndarray, q: np.ndarray, _: list[np.ndarray], flags: np.ndarray, blocks) -> pa.Table:
        total = np.zeros(len(q))
        for cell, _, r, w in blocks:
            own = np.flatnonzero(flags[:, cell])
            for at in range(0, len(own), BLOCK):
                mine = own[at : at + BLOCK]
                total[mine] += np.exp(-(_distances(q[mine], r) ** 2) / (2 * bandwidth**2)) @ w
        return pa.table({"rep": pa.array(ids), "total": pa.array(total)})

    sums = _met(cut(_grouped(distinct, cells)), cells, matter, work, "rep long, total double").groupBy("rep").agg(F.sum("total").alias("total"))
    return members.join(sums, "rep", "left").select("id", F.coalesce("total", F.lit(0.0)).alias("total"))


def distance_stats(queries: DataFrame, refs: DataFrame, k: int, bandwidth: float | None = 1.0) -> DataFrame:
    """id, nearest, kth, kde, n for each query: distances to all references, the Gaussian density there, and their number; without a bandwidth no kde."""
    n = F.lit(refs.count())
    found = nearest(queries, refs, k).select("id", F.array_min("dists").alias("nearest"), F.array_max("dists").alias("kth"))
    if bandwidth is None:
        return found.withColumn("n", n)
    first = queries.select(F.size("z").alias("dim")).head(1)
    scale = (2 * math.pi * bandwidth**2) ** ((first[0].dim if first else 0) / 2)
    return found.join(kernel_sums(queries, refs, bandwidth), "id").select("id", "nearest", "kth", (F.col("total") / n / F.lit(scale)).alias("kde"), n.alias("n"))


def volume_density(kth: Column, k: int, n: int, dim: int) -> Column:
    """(k / n) over the volume of the ball that holds the k nearest."""
    return F.lit(k / n) / (F.lit(math.pi ** (dim / 2) / math.gamma(dim / 2 + 1)) * F.pow(kth, F.lit(float(dim))))


def knn_scores(pos: DataFrame, neg: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """id, score: distance to the k-th negative over the distance to the (k+1)-th positive reference; with ``most``, of samples of that size."""
    p, n = (pos, neg) if most is None else (references(pos, most), references(neg, most))
    k = min(k, p.count() - 1, n.count() - 1)
    if k < 1:
        return pos.select("id", F.lit(1.0).alias("score"))
    a = distance_stats(pos, p, k + 1, None).select("id", F.col("kth").alias("dp"))
    b = distance_stats(pos, n, k, None).select("id", F.col("kth").alias("dn"))
    return a.join(b, "id").select("id", (F.col("dn") / (F.col("dp") + 1e-8)).alias("score"))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(eps)) * F.greatest(F.sqrt(dot(b, b)), F.lit(eps)))


def cosine_pairs(rows: DataFrame, eps: float = 1e-8) -> DataFrame:
    """i, j, sim for each pair i < j of ids: ``cosine`` by products of blocks."""
    left, right = _packed_blocks(rows, "i", "qid", "q"), _packed_blocks(rows, "j", "rid", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = b.column(0).to_pylist()
            for row in range(b.num_rows):
                qid, q, rid, r = (b.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(1, 5))
                q, r = (z.reshape(len(x), -1) / np.maximum(np.sqrt((z.reshape(len(x), -1) ** 2).sum(1)), eps)[:, None] for x, z in ((qid, q), (rid, r)))
                for at in range(0, len(q), 64):
                    sim = q[at : at + 64] @ r.T
                    x, y = np.nonzero(qid[at : at + 64, None] < rid if same[row] else np.ones(sim.shape, bool))
                    i, j = qid[at + x], rid[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(sim[x, y])], names=["i", "j", "sim"])

    met = left.join(right, F.col("i") <= F.col("j")).select((F.col("i") == F.col("j")).alias("same"), "qid", "q", "rid", "r")
    return met.mapInArrow(run, "i long, j long, sim double")


def frequency_loss(rows: DataFrame, beta: float, lam: float) -> DataFrame:
    """loss: mean of -s * exp(-beta * (f_pos - f_neg)), plus lam times the mean square of s."""
    return rows.agg((F.avg(-F.col("s") * F.exp(-beta * (F.col("f_pos") - F.col("f_neg")))) + lam * F.avg(F.col("s") * F.col("s"))).alias("loss"))


def first_pairs(rows: DataFrame, level: str, first: int = 20) -> DataFrame:
    """level, a, b: each level's first pairs a < b of ids, in order.

    They lie among the level's first ids, one more than pairs are wanted, so
    no other rows meet.
    """
    w = Window.partitionBy("level").orderBy("id")
    ids = cut(rows.select(F.col(level).alias("level"), "id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first + 1).drop("_r"))
    pairs = ids.toDF("level", "a").join(ids.toDF("level", "b"), "level").filter("a < b")
    order = Window.partitionBy("level").orderBy("a", "b")
    return pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= first).drop("_r")


def reconstruction_loss(pairs: DataFrame) -> DataFrame:
    """loss: mean square of similarity less kernel over each level's pairs, averaged over levels."""
    return pairs.groupBy("level").agg(F.avg(F.pow(F.col("sim") - F.col("kernel"), F.lit(2.0))).alias("l")).agg(F.avg("l").alias("loss"))


def random_planes(n: int, dim: int, seed: int = 0) -> list[list[float]]:
    """Gaussian hash planes."""
    return np.random.default_rng(seed).normal(size=(n, dim)).tolist()


def wasserstein(a: np.ndarray, b: np.ndarray) -> float:
    """Optimal transport cost of two sets of vectors with equal weights in each, under the Hamming distance of labels.

    Sets of different sizes are repeated to their least common size.
    """
    from .ged import assignment

    n = math.lcm(len(a), len(b))
    x, y = np.repeat(a, n // len(a), axis=0), np.repeat(b, n // len(b), axis=0)
    cost = (x[:, None, :] != y[None, :, :]).mean(2)
    return assignment(cost)[1] / n


def label_shares(sets: DataFrame, by: list[str]) -> DataFrame:
    """by, round, label, share: how much of a set's nodes have a label in a round; ``rounds`` holds the nodes' labels of each round."""
    each = sets.select(*by, F.posexplode("rounds").alias("round", "_l")).select(*by, "round", F.size("_l").alias("_n"), F.explode("_l").alias("label"))
    return each.groupBy(*by, "round", "label").agg((F.count("*") / F.first("_n")).alias("share"))


def wwl_kernel(sets: DataFrame, lam: float = 1.0, within: tuple[str, ...] = ()) -> DataFrame:
    """i, j, kernel: exp(-lam * transport cost) over pairs i <= j of rows (id, rounds) that have a label in common.

    A pair without one has the kernel exp(-lam) and isn't listed. With
    ``within``, only pairs with equal values in those columns are. A node's
    label names those of the rounds before, so the share of rounds in which two
    nodes differ is a distance in a tree, and the cheapest transport moves in
    each round what the two sets don't share: the cost is one less the common
    share of labels, averaged over rounds. That takes a join on labels, not a
    look at every pair.
    """
    keys = list(within)
    rounds = sets.select(F.size("rounds").alias("n")).head(1)
    n = rounds[0].n if rounds else 1
    shares = label_shares(sets, [*keys, "id"])
    a, b = shares.withColumnsRenamed({"id": "i", "share": "_a"}), shares.withColumnsRenamed({"id": "j", "share": "_b"})
    met = a.join(b, [*keys, "round", "label"]).filter("i <= j")
    common = met.groupBy(*keys, "i", "j").agg(F.sum(F.least("_a", "_b")).alias("_c"))
    return common.select(*keys, "i", "j", F.exp(-F.lit(lam) * (1 - F.col("_c") / n)).alias("kernel"))


def wwl_class() -> Column:
    """The name of a set's class, by ``rounds``: the MD5 of its nodes' labels in the last one."""
    return F.md5(F.array_join(F.sort_array(F.element_at("rounds", -1)), ","))


def class_kernel(named: DataFrame, lam: float = 1.0) -> DataFrame:
    """i, j, n_i, n_j, kernel of the classes i <= j that share a label; ``named`` has each set's class i and rounds, and n, its number, or one row a set without."""
    n = F.sum("n") if "n" in named.columns else F.count("*")
    classes = cut(named.groupBy(F.col("i").alias("id")).agg(F.first("rounds").alias("rounds"), n.alias("n")))
    n_i, n_j = classes.select(F.col("id").alias("i"), F.col("n").alias("n_i")), classes.select(F.col("id").alias("j"), F.col("n").alias("n_j"))
    return wwl_kernel(classes.select("id", "rounds"), lam).join(n_i, "i").join(n_j, "j").select("i", "j", "n_i", "n_j", "kernel")


def wwl_classes(labelled: DataFrame, lam: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((graph_id, nodes, i), (i, j, n_i, n_j, kernel)): the class of each set, and the kernel of classes i <= j that share a label.

    Sets whose nodes have the same labels in the last round, and so in all, in
    any order, are of one class, since their kernels with any set are equal. A
    class is named by the MD5 of those labels; n_i and n_j are its sets.
    """
    keyed = cut(labelled.select("graph_id", "nodes", wwl_class().alias("i"), "rounds"))
    return keyed.select("graph_id", "nodes", "i"), class_kernel(keyed, lam)


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, every: int = 1) -> DataFrame:
    """id, other, rank, dist: of each query's k nearest references every so-manieth."""
    ranked = nearest(queries, rows, k).select("id", F.posexplode(F.arrays_zip("others", "dists")).alias("at", "x")).filter(F.col("at") % every == 0)
    return ranked.select("id", F.col("x.others").alias("other"), (F.col("at") + 1).alias("rank"), F.col("x.dists").alias("dist"))
