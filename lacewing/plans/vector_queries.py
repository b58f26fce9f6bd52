"""Queries over vectors, result tables and classification."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import classification, graphs, results, sampling, scoring, subgraphs, vectors
from ..sources import collections as src
from . import sql

Q: dict = {}
S: dict[str, str] = {}
DIM = 64


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text is not None:
            S[f.__name__] = text
        return f

    return add


def _vectors(spark, d):
    """id, z, label, role: label 0 is positive."""
    e = src.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"), "label", F.when(F.col("label") == 0, "pos").otherwise("neg").alias("role"))


_V = "v as (select vec_id id, embedding::double[] z, label, case when label = 0 then 'pos' else 'neg' end as role from embeddings)"


@query(f"with {_V}, x as (select id, i, sum(z[j + 1] * ((i * 31 + j * 17 + i * j) % 7 - 3)) p from v, range(8) a(i), range(64) b(j) group by all) select id, string_agg(case when p > 0 then '1' else '0' end, '' order by i) code from x group by 1")
def v1_simhash(spark, d):
    return _vectors(spark, d).select("id", vectors.simhash(F.col("z"), vectors.fixed_planes(8, DIM)).alias("code"))


@query(f"with {_V}, x as (select id, i, sum(z[j + 1] * ((i * 31 + j * 17 + i * j) % 7 - 3)) p from v, range(4) a(i), range(64) b(j) group by all), c as (select id, string_agg(case when p > 0 then '1' else '0' end, '' order by i) code from x group by 1) select id, dense_rank() over (order by code)::int motif from c")
def v1_motif_ids(spark, d):
    """Codes numbered from 1 in order."""
    coded = _vectors(spark, d).select("id", vectors.simhash(F.col("z"), vectors.fixed_planes(4, DIM)).alias("code"))
    ids = classification.bucket_vocabulary(coded.withColumnRenamed("code", "bucket"))
    return coded.join(F.broadcast(ids), F.col("code") == F.col("bucket")).select("id", (F.col("idx") + 1).cast("int").alias("motif"))  # 16 codes at most


@query(f"with {_V}, x as (select role, unnest(range(64)) pos, unnest(z) y from v) select role, pos::int pos, round(avg(y), 6) m from x group by all")
def v1_class_means(spark, d):
    x = _vectors(spark, d).select("role", F.posexplode("z").alias("pos", "y"))
    return x.groupBy("role", "pos").agg(F.round(F.avg("y"), 6).alias("m"))


@query(f"with {_V}, x as (select role, unnest(range(64)) pos, unnest(z) y from v), s as (select role, pos, var_pop(y) * count(*) w from x group by all) select round(sum(w), 4) trace from s")
def v1_within_scatter_trace(spark, d):
    m = vectors.moments(_vectors(spark, d), DIM)
    trace = sum(float((q - n * (s[:, None] / n) @ (s[None, :] / n)).trace()) for n, s, q in m.values())
    return spark.createDataFrame([(round(trace, 4),)], "trace double")


@query(f"with {_V}, p as (select role, list_sum(list_transform(z, lambda x, j: x * ((j - 1) * 17 % 7 - 3))) y from v), s as (select avg(y) filter (role = 'pos') mp, avg(y) filter (role = 'neg') mn, stddev_pop(y) filter (role = 'pos') sp, stddev_pop(y) filter (role = 'neg') sn from p) select round((mp - mn) / (sp + sn + 1e-8), 6) separation from s")
def v1_fisher_separation(spark, d):
    p = _vectors(spark, d).select("role", vectors.dot(F.col("z"), F.array(*map(F.lit, vectors.fixed_planes(1, DIM)[0]))).alias("y"))
    of = lambda f, r: f(F.when(F.col("role") == r, F.col("y")))
    return p.agg(F.round((of(F.avg, "pos") - of(F.avg, "neg")) / (of(F.stddev_pop, "pos") + of(F.stddev_pop, "neg") + 1e-8), 6).alias("separation"))


_DIST = f"{_V}, dd as (select a.id, b.id o, sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) dist, b.role from v a, v b), rk as (select id, dist, row_number() over (partition by id order by dist) rn from dd)"


@query(f"with {_DIST} select id, round(dist, 5) kth from rk where rn = 6")
def v1_knn_distance(spark, d):
    v = _vectors(spark, d)
    return vectors.distance_stats(v, v, 6, None).select("id", F.round("kth", 5).alias("kth"))


@query(f"with {_DIST} select id, round(ln(avg(exp(-dist * dist / 2))) - 32 * ln(2 * pi()), 5) log_density from dd group by 1")
def v1_kde(spark, d):
    v = _vectors(spark, d)
    return vectors.kernel_sums(v, v).select("id", F.round(F.log(F.col("total") / v.count()) - DIM / 2 * math.log(2 * math.pi), 5).alias("log_density"))


@query(f"with {_DIST} select id, round(1 / min(dist), 4) density from dd where role = 'neg' and id in (select id from v where role = 'pos') group by 1")
def v1_min_density(spark, d):
    v = _vectors(spark, d)
    got = vectors.distance_stats(v.filter("role = 'pos'"), v.filter("role = 'neg'"), 1, None)
    return got.select("id", F.round(1 / F.col("nearest"), 4).alias("density"))


@query(f"with {_DIST}, n as (select count(*) n from v) select id, round(ln(5.0 / n) - 64 * ln(dist) - (32 * ln(pi()) - lgamma(33)), 4) log_density from rk, n where rn = 5")
def v1_volume_density(spark, d):
    v = _vectors(spark, d)
    got = vectors.distance_stats(v, v, 5, None)
    constant = math.log(5) - (DIM / 2 * math.log(math.pi) - math.lgamma(DIM / 2 + 1))
    return got.select("id", F.round(F.lit(constant) - F.log("n") - DIM * F.log("kth"), 4).alias("log_density"))


@query(f"with {_DIST}, p as (select dd.id, dd.role, dist, row_number() over (partition by dd.id, dd.role order by dist) rn from dd join v on v.id = dd.id and v.role = 'pos') select a.id, round(b.dist / (a.dist + 1e-8), 5) score from p a join p b on a.id = b.id and a.role = 'pos' and b.role = 'neg' and a.rn = 11 and b.rn = 10")
def v1_knn_score(spark, d):
    v = _vectors(spark, d)
    return vectors.knn_scores(v.filter("role = 'pos'"), v.filter("role = 'neg'"), 10).select("id", F.round("score", 5).alias("score"))


@query(f"with {_V} select a.id i, b.id j, round(list_cosine_similarity(a.z, b.z), 5) + 0.0 sim from v a, v b where a.id < b.id")
def v1_cosine_matrix(spark, d):
    """Every pair of vectors."""
    return vectors.cosine_pairs(_vectors(spark, d)).select("i", "j", (F.round("sim", 5) + 0.0).alias("sim"))  # no negative zero


@query(f"with {_DIST}, k as (select dd.id, dd.role, 1 / min(dist) f from dd join v on v.id = dd.id and v.role = 'pos' where dd.o <> dd.id group by all), x as (select a.id, a.f fp, b.f fn, (a.id % 7) / 7.0 s from k a join k b on a.id = b.id and a.role = 'pos' and b.role = 'neg') select round(avg(-s * exp(-0.5 * (fp - fn))) + 0.1 * avg(s * s), 5) loss from x")
def v1_freq_loss(spark, d):
    v = _vectors(spark, d)
    pos = v.filter("role = 'pos'")
    fp = vectors.distance_stats(pos, pos, 2, None).select("id", (1 / F.col("kth")).alias("f_pos"))  # the second nearest, since itself is the first
    fn = vectors.distance_stats(pos, v.filter("role = 'neg'"), 1, None).select("id", (1 / F.col("nearest")).alias("f_neg"))
    rows = fp.join(fn, "id").withColumn("s", F.col("id") % 7 / 7.0)
    return vectors.frequency_loss(rows, 0.5, 0.1).select(F.round("loss", 5).alias("loss"))


@query(f"with {_V}, p as (select a.label level, a.id a, b.id b, list_cosine_similarity(a.z, b.z) sim, 1.0 / (1 + abs(a.id - b.id)) kernel from v a join v b on a.label = b.label and a.id < b.id), r as (select *, row_number() over (partition by level order by a, b) rn from p) select round(avg(l), 6) loss from (select level, avg((sim - kernel) ** 2) l from r where rn <= 20 group by 1)")
def v1_reconstruction_loss(spark, d):
    v = _vectors(spark, d).select("label", "id", "z")
    chosen = vectors.first_pairs(v, "label")
    x, y = v.select(F.col("id").alias("a"), F.col("z").alias("x")), v.select(F.col("id").alias("b"), F.col("z").alias("y"))
    pairs = chosen.join(x, "a").join(y, "b")
    pairs = pairs.select("level", "a", "b", vectors.cosine(F.col("x"), F.col("y")).alias("sim"), (1.0 / (1 + F.abs(F.col("a") - F.col("b")))).alias("kernel"))
    return vectors.reconstruction_loss(pairs).select(F.round("loss", 6).alias("loss"))


@query()
def v1_lda_planes(spark, d):
    planes, separation = vectors.lda_planes(_vectors(spark, d), DIM, 16)
    return spark.createDataFrame([(i, separation, p.tolist()) for i, p in enumerate(planes)], "i int, separation double, w array<double>")


@query()
def v1_pca(spark, d):
    planes, share = vectors.pca_planes(_vectors(spark, d), DIM, 8)
    return spark.createDataFrame([(i, float(s), p.tolist()) for i, (p, s) in enumerate(zip(planes, share, strict=True))], "i int, share double, w array<double>")


@query()
def v1_lda_buckets(spark, d):
    """SimHash by fitted planes, then the G-statistic of its buckets."""
    v = _vectors(spark, d)
    planes, _ = vectors.lda_planes(v, DIM, 4)
    coded = v.select("role", vectors.simhash(F.col("z"), planes.tolist()).alias("bucket"))
    return scoring.gstat(scoring.bucket_counts(coded.groupBy("bucket", "role").agg(F.count("*").alias("n"))))


@query()
def v1_tree_leaf(spark, d):
    return vectors.tree_leaves(_vectors(spark, d), DIM).select("id", "role", "leaf")


@query(f"with {_V}, e as (select id, list_transform(z, lambda x: exp(x)) e from v), p as (select id, list_transform(e, lambda x: x / list_sum(e)) p from e) select id, round(1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(64), 6) score from p")
def v1_attribution_score(spark, d):
    e = _vectors(spark, d).select("id", F.transform("z", lambda x: F.exp(x)).alias("e"))
    e = e.withColumn("t", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    p = e.select("id", F.transform("e", lambda x: x / F.col("t")).alias("p"))
    return p.select("id", F.round(scoring.attribution_score(F.col("p")), 6).alias("score"))


@query(f"with {_V} select id, list_position(z, list_max(z))::int - 1 pred from v")
def v1_argmax_class(spark, d):
    return _vectors(spark, d).select("id", results.argmax_class(F.col("z")).alias("pred"))


@query(f"with {_V}, x as (select case when label < 2 then 1 else 0 end is_motif, z[1] sigma from v) select is_motif, count(*) n, round(min(sigma), 6) low, round(quantile_cont(sigma, 0.5), 6) mid, round(max(sigma), 6) high from x group by 1")
def v1_status_spread(spark, d):
    x = _vectors(spark, d).select(F.when(F.col("label") < 2, 1).otherwise(0).alias("is_motif"), F.col("z")[0].alias("sigma"))
    return scoring.status_spread(x).select("is_motif", "n", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


@query(f"with {_DIST.replace('row_number() over (partition by id order by dist)', 'row_number() over (partition by id order by dist, o)').replace('select id, dist,', 'select id, o, dist,')} select id, o other, rn::int as rank, round(dist, 5) dist from rk where rn in (1, 6, 11, 16)")
def v1_nearest_view(spark, d):
    """Neighbours 1, 6, 11 and 16 of every vector, as a smoothness view shows them."""
    v = _vectors(spark, d)
    return vectors.nearest_rows(v, v, 20, 5).select("id", "other", "rank", F.round("dist", 5).alias("dist"))


def _wwl(sets):
    """Sets of four nodes with their class i and labels: induced edges alone decide them, so each pattern is labelled once."""
    return subgraphs.by_pattern(sets, 4, lambda p: subgraphs.wl_labels(p, None, 4).withColumn("i", vectors.wwl_class()))


# labels of the sets of four nodes after 0 to 4 rounds, and each set's class
_WWL = f"{sql.G2}, {sql.sym('g2')}, {sql.K3}, {sql.K4}, {sql.profile('k4')}, {sql.wl_rounds(4)}, m as (select graph_id, nodes, md5(string_agg(l, ',' order by l)) i from l4 group by all)"


@query(f"with {_WWL} select graph_id, array_to_string(nodes, ',') nodes, i from m")
def g2_wwl_classes(spark, d):
    """The class of every four-node set: sets with equal labels after four rounds."""
    found = _wwl(subgraphs.induced_subgraphs(src.event_week(spark, d), 4))
    return found.select("graph_id", F.array_join("nodes", ",").alias("nodes"), "i")


@query(
    f"with {_WWL}, c as (select i, count(*) n, min({{'g': graph_id, 'nodes': nodes}}) x from m group by 1), "
    "p as (select i, al.r, l, count(*) / 4.0 share from c join al on al.graph_id = c.x.g and al.nodes = c.x.nodes group by all), "
    "o as (select a.i i, b.i j, sum(least(a.share, b.share)) c from p a join p b on a.r = b.r and a.l = b.l and a.i <= b.i group by all) "
    "select o.i, o.j, x.n n_i, y.n n_j, round(exp(-(1 - o.c / 5)), 6) kernel from o join c x on x.i = o.i join c y on y.i = o.j"
)
def g2_wwl_kernel(spark, d):
    """Kernel between classes of equal label sets that have a label in common."""
    counts = subgraphs.induced_subgraphs(src.event_week(spark, d), 4).groupBy("local").agg(F.count("*").alias("n"))  # a row a pattern
    return vectors.class_kernel(_wwl(counts)).withColumn("kernel", F.round("kernel", 6))


# -- result tables: runs are the lineitem rows of a part's ship mode, so to speak

_R = "r as (select cast(l_suppkey % 4 as int) dataset, cast(l_partkey % 3 as int) level, l_linenumber % 2 = 0 dummy, l_quantity jaccard, l_orderkey * 10 + l_linenumber step from lineitem)"


def _runs(spark, d):
    li = src.table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 4).cast("int").alias("dataset"), (F.col("l_partkey") % 3).cast("int").alias("level"), (F.col("l_linenumber") % 2 == 0).alias("dummy"), F.col("l_quantity").alias("jaccard"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("step"))


@query("with g as (select d.x dataset, l.x level from range(6) d(x), range(5) l(x)) select g.dataset, g.level from g where not exists (select 1 from lineitem where l_suppkey % 4 = g.dataset and l_partkey % 3 = g.level)")
def results_antijoin(spark, d):
    grid = spark.range(6).select(F.col("id").alias("dataset")).crossJoin(spark.range(5).select(F.col("id").alias("level")))
    done = _runs(spark, d).select(F.col("dataset").cast("long").alias("dataset"), F.col("level").cast("long").alias("level"))
    return results.still_to_do(grid, done, ["dataset", "level"])


@query(f"with {_R} select dataset, level, round(avg(jaccard), 6) mean, round(stddev_pop(jaccard), 6) std from r group by all")
def results_mean_std(spark, d):
    return results.mean_std(_runs(spark, d), ["dataset", "level"], "jaccard").select("dataset", "level", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"with {_R}, x as (select *, row_number() over (partition by dataset order by jaccard desc, step) rn from r) select dataset, level, dummy, jaccard, step from x where rn = 1")
def results_argmax_group(spark, d):
    return results.best_rows(_runs(spark, d), ["dataset"], F.desc("jaccard"), F.asc("step"))


@query(f"with {_R}, m as (select dataset, level, avg(jaccard) m, stddev_samp(jaccard) s from r group by all), x as (select *, row_number() over (partition by dataset order by m desc, s) rn from m) select dataset, level, round(m, 6) mean, round(s, 6) std from x where rn = 1")
def results_cv_select(spark, d):
    m = results.mean_std(_runs(spark, d), ["dataset", "level"], "jaccard", sample=True)
    return results.best_rows(m, ["dataset"], F.desc("mean"), F.asc("std")).select("dataset", "level", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"with {_R}, m as (select dataset, level, dummy, avg(jaccard) j from r where level > 0 or not dummy group by all) select a.dataset, a.level, round(a.j, 6) jaccard, round(coalesce(b.j, 0), 6) control from m a left join m b on a.dataset = b.dataset and a.level = b.level and b.dummy where not a.dummy")
def results_selfjoin_dummy(spark, d):
    m = _runs(spark, d).filter("level > 0 or not dummy").groupBy("dataset", "level", "dummy").agg(F.avg("jaccard").alias("jaccard"))
    return results.against_control(m, ["dataset", "level"], "dummy", "jaccard").select("dataset", "level", F.round("jaccard", 6).alias("jaccard"), F.round("control", 6).alias("control"))


@query(f"with {_R} select dataset, round(avg(jaccard) filter (level = 0), 6) as \"0\", round(avg(jaccard) filter (level = 1), 6) as \"1\", round(avg(jaccard) filter (level = 2), 6) as \"2\" from r group by 1")
def results_pivot(spark, d):
    m = _runs(spark, d).groupBy("dataset", "level").agg(F.round(F.avg("jaccard"), 6).alias("m"))
    return results.pivoted(m, ["dataset"], "level", [0, 1, 2], "m")


@query(f"with {_R}, x as (select dataset, jaccard, row_number() over (partition by dataset order by step desc) rn from r where step > 0) select dataset, round(stddev_samp(jaccard), 6) std from x where rn <= 50 group by 1")
def results_last50_std(spark, d):
    # a step is unique to a line, so the order is total
    return results.last_rows_std(_runs(spark, d), ["dataset"], "step", "jaccard").withColumn("std", F.round("std", 6))


@query(f"with {_R}, m as (select dataset, avg(jaccard) m, stddev_pop(jaccard) s from r group by 1) select dataset, printf('%.3f ± %.3f', m, s) cell, regexp_replace('barbell-d0.05-' || dataset, '-d[0-9.]+', '', 'g') as name from m")
def results_plus_minus(spark, d):
    m = results.mean_std(_runs(spark, d), ["dataset"], "jaccard")
    return m.select("dataset", results.plus_minus(F.col("mean"), F.col("std")).alias("cell"), results.without_distortion(F.concat(F.lit("barbell-d0.05-"), "dataset")).alias("name"))


@query(f"with {_R} select dataset, round(avg(case when level = cast(jaccard as int) % 3 then 1.0 else 0.0 end), 6) accuracy from r group by 1")
def results_accuracy(spark, d):
    rows = _runs(spark, d).select("dataset", F.col("level").alias("y"), (F.col("jaccard").cast("int") % 3).alias("pred"))
    return results.accuracy(rows, ["dataset"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"with {_R}, f as (select dataset, avg(jaccard) m from r group by 1) select round(avg(m), 6) mean, round(stddev_samp(m), 6) std from f")
def results_fold_stats(spark, d):
    f = _runs(spark, d).groupBy("dataset").agg(F.avg("jaccard").alias("m"))
    return f.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("std"))


# -- classification


@query()
def rf_events(spark, d):
    """Random forest over ten folds: is a week an even user's? 50 sampled sets of three or four nodes a graph, label histograms of 32 places, 16 planes a fold, 500 trees."""
    e = src.event_week(spark, d)
    subs = subgraphs.sample_subgraphs(cut(sampling.sampled_sets(e, 3, 4)), 50).select("graph_id", "nodes")
    labels = graphs.degrees(e).select("graph_id", "node", F.col("deg").cast("string").alias("label"))
    labelled = subgraphs.first_labels(subgraphs.induced(subs.distinct(), e), labels)
    found = subgraphs.by_labelled_pattern(labelled, lambda p: subgraphs.wl_histograms(subgraphs.wl_rounds(p, 4), 32))
    rows = subs.join(found.select("graph_id", "nodes", "vec"), ["graph_id", "nodes"])
    classes = graphs.nodes_of(e).select("graph_id").distinct().withColumn("class", 1 - (F.floor(F.col("graph_id") / 100) % 2).cast("int"))
    codes = classification.fold_codes(rows, src.stratified_folds(classes, 10), 10, 32, 16)
    return classification.validate_folds(codes, 10)
