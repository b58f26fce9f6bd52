"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a document (lines without a word are skipped)
are hashed together; a window that occurs before, in an earlier document or
higher up in the same one, is a repeat, and the lines that repeats cover are
removed. The first occurrence of every window stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fence import computed, exploded
from .skew import HEAVY_ROWS, HEAVY_SHARE
from .store import Workspace

WINDOW = 3
#: Lists of repeats up to this many documents and windows (some 50 MB) are broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_WINDOWS = 1 << 19, 1 << 22
_WORD = r"[^\x20\x09-\x0D]"


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _keyed(docs: DataFrame, name: str = "row") -> DataFrame:
    """All columns packed in one, beside doc_id, the lines, and a digest of both."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(name), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("text_key"), text.alias("_text"))
    out = computed(out, lines=F.split("_text", "\n")).drop("_text")
    return computed(out, used=F.filter(_upto(F.size("lines")), lambda i: F.get(F.col("lines"), i).rlike(_WORD)))


def repeated_windows(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """(doc_id, text_key, starts): the windows of each document that occur before.

    ``starts`` counts used lines. The order is by doc_id (a missing one last),
    then by the digest, then by place.
    """
    lines = lambda j: F.get(F.col("lines"), F.get(F.col("used"), j))
    hashed = F.transform(
        _upto(F.size("used") - (WINDOW - 1)),
        # 64 and 32 bits of two different hashes
        lambda j: F.struct(j.alias("j"), F.xxhash64(*[lines(j + k) for k in range(WINDOW)]).alias("a"), F.hash(*[lines(j + k) for k in range(WINDOW)]).alias("b")),
    )
    rows = exploded(_keyed(docs).select("doc_id", "text_key", hashed.alias("ws")), F.col("ws"), "w")
    rows = workspace.keep(rows.select("doc_id", "text_key", "w.j", "w.a", "w.b", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord")), "windows")
    place = F.struct("ord", "text_key", "j")
    # one row a window and task goes into the shuffle, however often the window occurs
    first = workspace.keep(rows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    # a window with a large share of all rows, and so one of a bounded number, doesn't bring them to one task
    heavy = F.col("n") >= max(HEAVY_ROWS, rows.count() // HEAVY_SHARE + 1)
    hot = rows.join(F.broadcast(first.filter(heavy).drop("n")), ["a", "b"])
    cold = rows.join(F.broadcast(first.filter(heavy).select("a", "b")), ["a", "b"], "left_anti").join(first.filter(~heavy).drop("n"), ["a", "b"])
    later = hot.unionByName(cold).filter(place > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("j").alias("starts"))


def dedup(docs: DataFrame, workspace: Workspace | None = None, drop_emptied: bool = False) -> DataFrame:
    """``row`` (the input's columns), doc_id, text (what is left), n_lines, n_removed.

    Removed are the used lines covered by a window that occurs before; other
    lines stay as they were, so an untouched document comes back unchanged.
    Defined results: a null text stays null and has no lines; documents of fewer
    than three used lines have no window and stay; exact copies lose all lines
    but in the first; rows repeated with doc_id and text count as one document
    and get equal results; an empty table gives no rows.
    ``drop_emptied`` leaves out documents that lost their last used line.
    """
    ws = workspace or Workspace(docs.sparkSession, "linededup")
    found = ws.keep(repeated_windows(docs, ws), "repeats")
    ws.drop_all_but("repeats")
    n, total = found.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    starts = found.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "starts")
    if n <= BROADCAST_ROWS and total <= BROADCAST_WINDOWS:
        starts = F.broadcast(starts)
    rows = _keyed(docs)
    joined = rows.join(starts, rows["doc_id"].eqNullSafe(starts["_d"]) & (rows["text_key"] == starts["_k"]), "left").drop("_d", "_k")
    # merge the covered positions: used line numbers, then line numbers
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda j: F.sequence(j, j + (WINDOW - 1)))))
    joined = computed(joined, gone=F.transform(covered, lambda j: F.get(F.col("used"), j)))
    # what is left are the stretches between neighbouring removed lines
    joined = computed(joined, edges=F.concat(F.array(F.lit(-1)), F.sort_array("gone"), F.array(F.size("lines"))))
    edge = lambda i: F.get(F.col("edges"), i)
    left = F.flatten(F.transform(_upto(F.size("edges") - 1), lambda i: F.slice(F.col("lines"), edge(i) + 2, edge(i + 1) - edge(i) - 1)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    out = joined.select(
        "row", "doc_id", text.alias("text"), F.size("used").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed")
    )
    return out.filter("n_removed = 0 or n_removed < n_lines") if drop_emptied else out


def deduped_documents(docs: DataFrame) -> DataFrame:
    """The input with repeated lines removed, all columns kept; documents of which nothing is left go."""
    names = docs.columns
    out = dedup(docs, drop_emptied=True)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in names else {"text": F.col("text")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in names])
