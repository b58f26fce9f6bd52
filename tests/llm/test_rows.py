"""Near-duplicates are dropped by row: null and repeated doc_ids lose no other text and keep no copy."""

from fractions import Fraction

import corpus_pipeline
from lacewing.llm import ngram_join

from .fixtures import documents, frame, multiset
from .test_pairs import brute, shingles


def one_of_each(rows):
    rows = list(dict.fromkeys(rows))
    linked = brute([(i, t) for i, (_, t) in enumerate(rows)], 5, Fraction(4, 5))
    groups = {}
    for row, (_, _, c) in zip(rows, linked, strict=True):
        if shingles(row[1], 5):
            groups.setdefault(c, []).append(row)
    empty = [r for r in rows if not shingles(r[1], 5)]
    return empty, list(groups.values())


def test_null_and_repeated_ids(spark):
    words = [" ".join(f"{g}{k}" for k in range(60)) for g in "abcd"]
    near = [w + " end" for w in words]
    rows = documents(2, 80) + [(None, words[0]), (None, near[0]), (900001, words[1]), (900001, near[1]), (900001, words[2]), (900002, near[2]), (900002, words[3]), (None, " "), (900003, " ")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()]
    empty, groups = one_of_each(rows)
    assert len(got) == len(set(got)) and multiset(r for r in got if not shingles(r[1], 5)) == multiset(empty)
    for group in groups:
        kept = [r for r in got if r in group]
        first = min((d is None, d or 0) for d, _ in group)
        assert len(kept) == 1 and (kept[0][0] is None, kept[0][0] or 0) == first
    assert len(got) == len(empty) + len(groups)
    assert (None, "unlike all others here") in got and (900002, words[3]) in got


def test_distinct_rows_leave_texts_where_they_are(spark, capsys):
    """Only rows that repeat doc_id and text are shuffled with their texts, whatever the broadcast threshold."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (1, f"{a} more"), (None, a), (5, b), (None, None), (7, " "), (8, "")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join.distinct_rows(frame(spark, rows, 3))
        assert multiset((r.doc_id, r.text) for r in got.collect()) == multiset(rows[i] for i in (1, 3, 4, 5, 6))
        got.explain()
        assert "Exchange hashpartitioning" not in capsys.readouterr().out
        twice = ngram_join.distinct_rows(frame(spark, rows * 2, 3))
        assert multiset((r.doc_id, r.text) for r in twice.collect()) == multiset(rows[i] for i in (1, 3, 4, 5, 6))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
