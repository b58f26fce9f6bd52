"""Licence scan by a positional index of rare words, with DataFrame functions only.

Templates are sequences of words with one mandatory key phrase each. An index
holds their postings: word, template, place. The documents' own counts say how
rare each licence word is. A file looks up only those of its licence words that
are the rarest, the highest in inverse document frequency, of a key phrase that
its vocabulary admits; each such place proposes a template at a relative
position. The words around it are joined with the postings of that template at
the same relative position, and the template is found where its whole key
phrase stands there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import words_of
from .fence import computed, exploded
from .store import Workspace


@dataclass(frozen=True)
class Template:
    """A licence notice; ``base`` ones are found by their key phrase alone, others need half of their words."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        """Where the key phrase begins."""
        words, key = self.words, self.key.split()
        at = [i for i in range(len(words)) if words[i : i + len(key)] == key]
        if not at:
            raise ValueError(f"{self.text!r} lacks its key phrase {self.key!r}")
        return at[0]


# fixed values: phrases of public licences
TEMPLATES = (
    Template("cc-by", "licensed under cc by", "cc by", True),
    Template("gpl", "licensed under the gnu general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("boost", "boost software license version 1 0", "boost software license"),
)

#: Postings up to this many (some 10 MB) are broadcast; more are shuffled.
BROADCAST_POSTINGS = 1 << 16
#: Found rows up to this many (some 50 MB) are broadcast; more are shuffled.
BROADCAST_ROWS = 1 << 18


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _table(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def _admits(key_words: Column, have: Column) -> Column:
    return F.size(F.array_except(key_words, have)) == 0


def licence_words(docs: DataFrame, templates: tuple[Template, ...], workspace: Workspace) -> DataFrame:
    """A written row for each input row: r, doc_id, n_words, have, hits.

    ``have`` are the file's different licence words, ``hits`` its licence words
    with their places; hits are left out where no key phrase can be complete.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    keys = F.array(*[_strings(sorted(set(t.key.split()))) for t in templates])
    rows = computed(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), words=words_of(F.col("text"))).drop("text")
    rows = computed(rows, have=F.filter(F.array_distinct("words"), lambda w: w.isin(vocabulary)))
    rows = computed(rows, admitted=F.exists(keys, lambda k: _admits(k, F.col("have"))))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    none = F.array().cast("array<struct<p:int,w:string>>")
    out = rows.select(
        F.monotonically_increasing_id().alias("r"), "doc_id", F.size("words").cast("long").alias("n_words"), "have", F.when(F.col("admitted"), placed).otherwise(none).alias("hits")
    )
    return workspace.keep(out, "words")


def rarity(rows: DataFrame) -> dict[str, int]:
    """In how many rows each licence word stands: at most as many numbers as the templates have words."""
    counts = exploded(rows.select("have"), F.col("have"), "w").groupBy("w").agg(F.count("*").alias("n"))
    return {r.w: r.n for r in counts.collect()}


def places(rows: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """r, t, at, matched: each place where a template's key phrase stands, and how many of its words stand around it as they should.

    ``at`` is the key phrase's first word; t is the template's number.
    """
    spark = rows.sparkSession
    counts = rarity(rows)
    # the fewer files have a word, the higher its inverse document frequency; equals are ordered by the word
    rarest = [min(t.key.split(), key=lambda w: (counts.get(w, 0), w)) for t in templates]
    postings, anchors = [], []
    for n, t in enumerate(templates):
        key = range(t.key_at, t.key_at + len(t.key.split()))
        postings += [F.struct(F.lit(n).alias("t"), F.lit(w).alias("w"), F.lit(i).alias("i"), F.lit(i in key).alias("must")) for i, w in enumerate(t.words)]
        first = next(i for i in key if t.words[i] == rarest[n])
        anchors.append(F.struct(F.lit(n).alias("t"), F.lit(rarest[n]).alias("w"), F.lit(first).alias("i"), F.lit(t.key_at).alias("key_at"), F.lit(len(key)).alias("n_key")))
    small = F.broadcast if len(postings) <= BROADCAST_POSTINGS else (lambda x: x)
    keys = F.array(*[F.struct(_strings(sorted(set(t.key.split()))).alias("k"), F.lit(w).alias("w")) for t, w in zip(templates, rarest, strict=True)])
    wanted = F.array_distinct(F.transform(F.filter(keys, lambda k: _admits(k["k"], F.col("have"))), lambda k: k["w"]))
    files = computed(rows.filter(F.size("hits") > 0).select("r", "have", "hits"), wanted=wanted)
    looked = F.filter(F.transform("hits", lambda h, k: F.struct(k.alias("k"), h.alias("h"))), lambda x: F.array_contains(F.col("wanted"), x["h"]["w"]))
    # a template's words are licence words: around a place they are among as many neighbours
    span = max(len(t.words) for t in templates) - 1
    near = lambda x: F.struct(x["h"]["p"].alias("p"), x["h"]["w"].alias("w"), F.slice(F.col("hits"), F.greatest(x["k"] - span, F.lit(0)) + 1, F.lit(2 * span + 1)).alias("near"))
    found = exploded(files.select("r", F.transform(looked, near).alias("found")), F.col("found"), "x").select("r", "x.p", "x.w", "x.near")
    proposed = found.join(small(_table(spark, anchors)), "w").select("r", "t", (F.col("p") - F.col("i")).alias("offset"), "key_at", "n_key", F.explode("near").alias("h"))
    proposed = proposed.select("r", "t", "offset", "key_at", "n_key", F.col("h.w").alias("w"), (F.col("h.p") - F.col("offset")).alias("i"))
    met = proposed.join(small(_table(spark, postings)), ["t", "w", "i"])
    met = met.groupBy("r", "t", "offset", "key_at", "n_key").agg(F.count("*").alias("matched"), F.sum(F.col("must").cast("long")).alias("n_must"))
    return met.filter("n_must = n_key").select("r", "t", (F.col("offset") + F.col("key_at")).cast("long").alias("at"), "matched")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, workspace: Workspace | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best share of a found template's words that stand in their
    places, 0 where nothing is found. Base templates are found at every place
    of their key phrase; another one is a label where half of its words stand
    with its key phrase. Defined results: a null text has no words and no
    labels; a null doc_id stays; repeated rows are scanned each; an empty table
    gives no rows; overlapping places count each; texts of any length are
    scanned whole; other columns are not read.
    """
    ws = workspace or Workspace(docs.sparkSession, "licenses")
    rows = licence_words(docs, templates, ws)
    facts = _table(
        rows.sparkSession,
        [F.struct(F.lit(n).alias("t"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(t.words)).alias("size")) for n, t in enumerate(templates)],
    )
    found = places(rows, templates).join(F.broadcast(facts) if len(templates) <= BROADCAST_POSTINGS else facts, "t").filter("base or 2 * matched >= size")
    base = lambda c: F.when(F.col("base"), F.col(c))
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = found.groupBy("r").agg(
        F.count(base("at")).alias("n_base"), F.min(base("at")).alias("first_word"), F.max(base("at")).alias("last_word"),
        labels(base("label")).alias("base_labels"), labels(F.col("label")).alias("labels"), F.max(F.col("matched") / F.col("size")).alias("score"),
    )
    found = ws.keep(found, "found")
    ws.drop_all_but("words", "found")
    # r is a row's own number: no key is frequent
    joined = rows.select("r", "doc_id", "n_words").join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "r", "left")
    empty = F.lit("")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", empty).alias("base_labels"), F.coalesce("labels", empty).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
