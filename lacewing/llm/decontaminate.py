"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window of T consecutive words is shared exactly when it is found by this
chain: hash every k-gram, keep the minimum of every w consecutive hashes where
k + w - 1 = T (so each shared window has a common kept hash), join the kept
hashes of documents and benchmark items, and extend each hit to the windows of
T words around it, which are compared word for word. Items shorter than T
words are one window each and take the same chain at their own length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fence import computed, exploded
from .store import Workspace

WINDOW = 13
GRAM = 6
#: Benchmark tables of up to this many rows are broadcast (some 100 MB at most); larger ones are shuffled.
BROADCAST_ROWS = 1 << 19
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, _SEPARATORS), lambda w: w != "")


def _upto(n: Column) -> Column:
    """0 .. n-1, empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: str, n: Column, k: int) -> Column:
    return F.transform(_upto(n - (k - 1)), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)]))


def _kept(grams: str, width: int) -> Column:
    """The minimum of each ``width`` consecutive hashes, each value once."""
    if width == 1:
        return F.array_distinct(grams)
    return F.array_distinct(F.transform(_upto(F.size(grams) - (width - 1)), lambda i: F.array_min(F.slice(F.col(grams), i + 1, width))))


def fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` with ``words`` to the same rows with n_words and prints_T for each length T."""
    out = computed(rows, n_words=F.size("words"), _h=F.transform("words", lambda w: F.xxhash64(w)))
    keep = [c for c in rows.columns if c != "words"] + ["n_words"]
    for t in lengths:
        k = min(GRAM, t)
        if f"_g{k}" not in out.columns:
            out = computed(out, **{f"_g{k}": _grams("_h", F.col("n_words"), k)})
        out = out.withColumn(f"prints_{t}", _kept(f"_g{k}", t - k + 1))
    return out.select(*keep, *[f"prints_{t}" for t in lengths])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _windows(words: str, starts: Column, t: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.array_join(F.slice(F.col(words), s + 1, t), " ").alias("window")))


def contamination(docs: DataFrame, benchmark: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """One row per input document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    ``text_key`` is a digest of doc_id and text that ties results to rows.
    Defined results: a null or empty text has no words, no hits and isn't
    contaminated; a null doc_id is a document like others; repeated rows get
    equal results; an item without words matches nothing, repeated items count
    once, and an item without item_id marks words but isn't counted; with an
    empty benchmark nothing is hit. Other columns are not read.
    """
    ws = workspace or Workspace(docs.sparkSession, "decontaminate")
    items = ws.keep(
        computed(benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].alias("text")), words=words_of(F.col("text")))
        .select("item_id", "words")
        .withColumn("t", F.least(F.size("words"), F.lit(WINDOW)))
        .filter("t > 0"),
        "items",
    )
    lengths = sorted(r.t for r in items.select("t").distinct().collect())  # WINDOW different values at most
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("text_key"), text.alias("text"))
    printed = ws.keep(fingerprints(computed(keyed, words=words_of(F.col("text"))).drop("text"), lengths), "prints")
    if not lengths:
        return _result(printed, None)
    item_prints = None
    windows = None
    for t in lengths:
        own = items.filter(F.col("t") == t)
        p = exploded(fingerprints(own.select("words"), [t]), F.col(f"prints_{t}"), "print").select(F.lit(t).alias("t"), "print")
        w = exploded(own, _windows("words", _upto(F.size("words") - (t - 1)), t), "w").select("item_id", F.col("w.window").alias("window"))
        item_prints = p if item_prints is None else item_prints.unionByName(p)
        windows = w if windows is None else windows.unionByName(w)
    item_prints = ws.keep(item_prints.distinct(), "item_prints")
    windows = ws.keep(windows.distinct(), "windows")
    n_prints, n_windows = item_prints.count(), windows.count()
    hits = None
    for t in lengths:
        h = exploded(printed.select("doc_id", "text_key", f"prints_{t}"), F.col(f"prints_{t}"), "print").select("doc_id", "text_key", F.lit(t).alias("t"), "print")
        hits = h if hits is None else hits.unionByName(h)
    # the documents' prints meet in one row a document: at most as many as the benchmark has
    matched = hits.join(_small(item_prints, n_prints), ["t", "print"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("t", "print")).alias("prints"))
    matched = ws.keep(matched, "matched")
    close = _small(matched.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_k"), matched.count())
    candidates = keyed.join(close, keyed["doc_id"].eqNullSafe(close["_d"]) & (keyed["text_key"] == close["_k"])).drop("_d", "_k")
    candidates = computed(candidates, words=words_of(F.col("text"))).drop("text")
    candidates = computed(candidates, n_words=F.size("words"), _h=F.transform("words", lambda w: F.xxhash64(w)))
    extended = None
    for t in lengths:
        k = min(GRAM, t)
        own = computed(candidates, _p=F.transform(F.filter("prints", lambda p: p["t"] == t), lambda p: p["print"])).filter(F.size("_p") > 0)
        own = computed(own, _g=_grams("_h", F.col("n_words"), k))
        own = computed(own, _at=F.filter(_upto(F.size("_g")), lambda i: F.array_contains(F.col("_p"), F.get(F.col("_g"), i))))
        # every window that contains a hit
        starts = F.array_distinct(F.flatten(F.transform("_at", lambda i: F.sequence(F.greatest(F.lit(0), i - (t - k)), F.least(i, F.col("n_words") - t)))))
        e = exploded(own.select("doc_id", "text_key", _windows("words", starts, t).alias("_w")), F.col("_w"), "w")
        e = e.select("doc_id", "text_key", F.lit(t).alias("t"), F.col("w.s").alias("s"), F.col("w.window").alias("window"))
        extended = e if extended is None else extended.unionByName(e)
    confirmed = ws.keep(extended.distinct().join(_small(windows, n_windows), "window").select("doc_id", "text_key", "t", "s", "item_id").distinct(), "confirmed")
    ws.drop_all_but("prints", "confirmed")
    per_doc = confirmed.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct(F.col("s").alias("s"), (F.col("s") + F.col("t")).alias("e")))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["e"]).alias("upto")),
        lambda a: a["n"].cast("long"),
    )
    found = per_doc.select(
        F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    )
    return _result(printed, found)


def _result(printed: DataFrame, found: DataFrame | None) -> DataFrame:
    rows = printed.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"))
    if found is None:
        rows = rows.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"))
    else:
        rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["text_key"] == found["_k"]), "left").select(
            "doc_id", "text_key", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        )
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows, with all their columns, that aren't contaminated."""
    names = docs.columns
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("text_key"))
    return packed.join(bad, packed["doc_id"].eqNullSafe(bad["_d"]) & (packed["text_key"] == bad["_k"]), "left_anti").select("row.*")
