"""Bucket counts, over-representation scores, predictions and their Jaccard measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_counts(counted: DataFrame) -> DataFrame:
    """bucket, r_pos, r_neg from rows (bucket, role, n)."""
    side = lambda r: F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0)).cast("long")
    return counted.groupBy("bucket").agg(side("pos").alias("r_pos"), side("neg").alias("r_neg"))


def gstat(counts: DataFrame, signed: bool = False) -> DataFrame:
    """Adds score: the G-statistic of each bucket against the base rate, for buckets with positives.

    Totals run over all buckets; without negatives their total counts as 1. The
    statistic is two-sided unless ``signed``.
    """
    totals = counts.agg(F.sum("r_pos").alias("tp"), F.greatest(F.sum("r_neg"), F.lit(1)).alias("tn"))
    rows = counts.join(F.broadcast(totals))  # one row
    base, n = F.col("tp") / (F.col("tp") + F.col("tn")), F.col("r_pos") + F.col("r_neg")
    term = lambda r, share: F.when(F.col(r) > 0, F.col(r) * F.log(F.col(r) / (n * share))).otherwise(0.0)
    score = 2 * (term("r_pos", base) + term("r_neg", 1 - base))
    if signed:
        score = F.when(F.col("r_pos") >= n * base, score).otherwise(-score)
    return rows.filter("r_pos > 0").select("bucket", "r_pos", "r_neg", score.alias("score"))


def count_score(counts: DataFrame, alpha: float = 1.5) -> DataFrame:
    score = F.pow(F.col("r_pos").cast("double"), F.lit(alpha)) / (F.col("r_pos") + F.col("r_neg") + 1e-8)
    return counts.filter("r_pos > 0").select("bucket", "r_pos", "r_neg", score.alias("score"))


def canonical_score(counts: DataFrame, n_pos: int, n_neg: int, alpha: float = 1.5) -> DataFrame:
    """Purity of the counts per graph."""
    fp, fn = F.col("r_pos") / F.lit(float(max(n_pos, 1))), F.col("r_neg") / F.lit(float(max(n_neg, 1)))
    return counts.filter("r_pos > 0").select("bucket", "r_pos", "r_neg", (F.pow(fp, F.lit(alpha)) / (fp + fn + 1e-8)).alias("score"))


SCORE = {"gstat": gstat, "count": count_score}


def top_buckets(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc("r_pos"), "bucket").limit(k)


def predict_subgraphs(subs: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """graph_id, node: nodes of each graph's k best sets, by bucket score (0 where unknown) and size."""
    s = subs.join(scored.select("bucket", "score"), "bucket", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("graph_id").orderBy(F.desc("score"), F.desc(F.size("nodes")), "nodes")
    return s.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("graph_id", F.explode("nodes").alias("node")).distinct()


def predict_buckets(subs: DataFrame, candidates: DataFrame) -> DataFrame:
    """bucket, graph_id, node: for each candidate bucket the nodes of its sets."""
    return subs.join(F.broadcast(candidates.select("bucket")), "bucket").select("bucket", "graph_id", F.explode("nodes").alias("node")).distinct()  # k rows


def micro_jaccard(predicted: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by..., n_inter, n_union, jaccard over all graphs; ``truth`` (graph_id, node) is the same for each group."""
    p = predicted.withColumn("_t", F.lit(1))
    hit = p.join(truth.withColumn("_h", F.lit(1)), ["graph_id", "node"], "left")
    sums = hit.groupBy(*by).agg(F.count("*").alias("n_pred"), F.count("_h").alias("n_inter"))
    total = truth.agg(F.count("*").alias("n_true"))
    union = F.col("n_pred") + F.col("n_true") - F.col("n_inter")
    return sums.join(F.broadcast(total)).select(*by, "n_inter", union.alias("n_union"), (F.col("n_inter") / F.greatest(union, F.lit(1))).alias("jaccard"))  # one row


def sigma_ranks(nodes: DataFrame, top_k: int) -> DataFrame:
    """motif, mean_sigma, rank, kept: predicted motifs by their mean score over nodes; kept is 0 beyond top_k."""
    mean = nodes.groupBy("motif").agg(F.avg("sigma").alias("mean_sigma"))
    ranked = mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_sigma"), "motif")))
    return ranked.withColumn("kept", F.when(F.col("rank") <= top_k, F.col("rank")).otherwise(0))


def pairwise_jaccard(nodes: DataFrame, background: bool = False) -> DataFrame:
    """pred, truth, jaccard of node sets, over rows (graph_id, node, pred, truth) with 0 for none.

    With ``background`` the nodes without a prediction are a prediction too.
    """
    predicted = F.col("pred") >= 0 if background else F.col("pred") > 0
    both = nodes.filter(predicted & (F.col("truth") > 0)).groupBy("pred", "truth").agg(F.count("*").alias("n"))
    p = nodes.filter(predicted).groupBy("pred").agg(F.count("*").alias("np"))
    t = nodes.filter("truth > 0").groupBy("truth").agg(F.count("*").alias("nt"))
    return both.join(p, "pred").join(t, "truth").select("pred", "truth", (F.col("n") / (F.col("np") + F.col("nt") - F.col("n"))).alias("jaccard"))


#: Predictions that an assignment can tell apart.
MOST_PREDICTIONS = 20


def assigned_jaccard(pairs: DataFrame) -> DataFrame:
    """One row, jaccard: the largest sum over assignments of different predictions to the true motifs; pairs are those of ``pairwise_jaccard``.

    States are the sets of predictions used so far with their best sum, at most
    2 ** MOST_PREDICTIONS rows. Each true motif in turn takes none or one that a
    state hasn't used, and the best sum of each set stays. Pairs that aren't
    listed add nothing.
    """
    known = pairs.collect()  # a row a prediction and motif
    names = sorted({r.pred for r in known})
    if len(names) > MOST_PREDICTIONS:
        raise ValueError(f"{len(names)} predictions: rank them and keep {MOST_PREDICTIONS} at most")
    states = pairs.sparkSession.range(1).select(F.lit(0).alias("used"), F.lit(0.0).alias("total"))
    for t in sorted({r.truth for r in known}):
        options = F.array(F.struct(F.lit(0).alias("bit"), F.lit(0.0).alias("j")), *[F.struct(F.lit(1 << names.index(r.pred)).alias("bit"), F.lit(float(r.jaccard)).alias("j")) for r in known if r.truth == t])
        grown = states.select("used", "total", F.inline(options)).filter(F.col("used").bitwiseAND(F.col("bit")) == 0)
        states = grown.groupBy(F.col("used").bitwiseOR(F.col("bit")).alias("used")).agg(F.max(F.col("total") + F.col("j")).alias("total"))
    return states.agg(F.max("total").alias("jaccard"))


def permutation_jaccard(pairs: list[tuple[int, int, float]], n_truth: int) -> float:
    """The largest sum of Jaccards over assignments of different predictions to the true motifs."""
    table: dict[int, dict[int, float]] = {}
    for p, t, j in pairs:
        table.setdefault(t, {})[p] = j
    best: dict[frozenset[int], float] = {frozenset(): 0.0}
    for t in range(1, n_truth + 1):
        grown = dict(best)
        for used, total in best.items():
            for p, j in table.get(t, {}).items():
                if p not in used:
                    k = used | {p}
                    grown[k] = max(grown.get(k, 0.0), total + j)
        best = grown
    return max(best.values())


def status_spread(nodes: DataFrame) -> DataFrame:
    """is_motif, n, low, mid, high: the spread of node scores by status."""
    return nodes.groupBy("is_motif").agg(F.count("*").alias("n"), F.min("sigma").alias("low"), F.percentile("sigma", F.lit(0.5)).alias("mid"), F.max("sigma").alias("high"))


def attribution_score(p: Column) -> Column:
    """1 - H(p) / H(uniform) of an array of probabilities."""
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return 1 - h / F.log(F.size(p).cast("double"))


def dictionary_loss(rows: DataFrame, atoms: list[list[float]]) -> DataFrame:
    """One row, loss: MSE of D D' against the identity, plus MSE of x against p D, over rows of ``x`` and probabilities ``p``."""
    n, dim = len(atoms), len(atoms[0])
    gram = [sum(a * b for a, b in zip(x, y, strict=True)) - (i == j) for i, x in enumerate(atoms) for j, y in enumerate(atoms)]
    own = sum(g * g for g in gram) / (n * n)
    error = None
    for d in range(dim):
        made = sum((F.col("p")[i] * F.lit(float(atoms[i][d])) for i in range(n)), F.lit(0.0))
        e = F.pow(F.col("x")[d] - made, F.lit(2.0))
        error = e if error is None else error + e
    return rows.agg((F.lit(own) + F.avg(error / dim)).alias("loss"))


def pattern_jaccard(patterns: DataFrame, truth: DataFrame, top_k: int) -> DataFrame:
    """pattern, n_inter, n_union, jaccard of an external miner's patterns against each motif, the best top_k patterns a motif.

    ``patterns`` has pattern, id and ``truth`` motif, id; ids are node numbers
    that run through all graphs.
    """
    p, t = patterns.select("pattern", "id").distinct(), truth.select("motif", "id").distinct()
    both = p.join(t, "id").groupBy("motif", "pattern").agg(F.count("*").alias("n_inter"))
    sizes = both.join(p.groupBy("pattern").agg(F.count("*").alias("n_p")), "pattern").join(t.groupBy("motif").agg(F.count("*").alias("n_t")), "motif")
    union = F.col("n_p") + F.col("n_t") - F.col("n_inter")
    scored = sizes.select("motif", "pattern", "n_inter", union.alias("n_union"), (F.col("n_inter") / union).alias("jaccard"))
    best = Window.partitionBy("motif").orderBy(F.desc("jaccard"), "pattern")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
