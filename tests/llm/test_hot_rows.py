"""Very many equal rows, and texts of one repeated word, meet in no single task."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lacewing.llm import substring_dedup, token_store
from lacewing.llm.store import Workspace

from .fixtures import frame, multiset
from .test_documents import removed_by_definition

WORD = public_tokenizers.path("word_bpe_49k.json")
PASSAGE = " ".join(f"p{k}" for k in range(30))


def many_equal_rows():
    return [(None, f"left {PASSAGE} right")] * 2000 + [(7, PASSAGE), (9, f"{PASSAGE} more"), (None, f"other {PASSAGE}")]


def test_equal_rows_without_doc_id_are_deduped(spark):
    rows = many_equal_rows()
    got = substring_dedup.dedup(frame(spark, rows, 5)).collect()
    assert len(got) == len(rows) and multiset(map(tuple, got)) == multiset(removed_by_definition(rows))


def test_texts_of_one_repeated_word(spark, monkeypatch):
    """Windows of one content are one row, however long the texts are."""
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", 2000)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 3000)
    rows = [(i, " ".join(["word"] * (400 + 7 * i))) for i in range(50)] + [(60, "word " * 5), (61, PASSAGE + " word" * 20)]
    sizes = []
    searched = substring_dedup.smallest_documents
    monkeypatch.setattr(substring_dedup, "smallest_documents", lambda words, ords: (sizes.append(sum(map(len, words))), searched(words, ords))[1])
    got = substring_dedup.dedup(frame(spark, rows, 4)).collect()
    assert multiset(map(tuple, got)) == multiset(removed_by_definition(rows))


def test_windows_repeated_in_a_segment_are_one_row(spark, monkeypatch):
    """Rows of a repeated word pair follow the different windows, not their places."""
    words = np.tile(np.array([3, 5], np.uint64), 150)
    segment = spark.createDataFrame([(1, 2, 9, bytearray(words.tobytes()))], "gram long, seg long, ord long, words binary")
    got = substring_dedup._cut_windows(segment).collect()
    assert sorted(r["at"] for r in got) == [list(range(0, 288, 2)), list(range(1, 288, 2))]
    assert all(np.frombuffer(r.words, np.uint64).tolist() == words[r["at"][0] :][:13].tolist() and r.ord == 9 for r in got)
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", 500)
    rows = [(i, f"w{i} " + "over again " * (30 + i) + f"x{i}") for i in range(20)] + [(50, "again " + "over again " * 12)]
    got = substring_dedup.dedup(frame(spark, rows, 3)).collect()
    assert multiset(map(tuple, got)) == multiset(removed_by_definition(rows))


def test_equal_rows_without_doc_id_are_dealt_to_all_parts(spark, monkeypatch):
    monkeypatch.setattr(token_store, "ROWS_A_PARTITION", 300)
    rows = [*many_equal_rows(), *[(100 + i, f"text {i}") for i in range(200)]]
    ws = Workspace(spark, "t")
    manifest = token_store.write(frame(spark, rows, 4), ws.path("f"), WORD, 2, ws)
    parts = [r.n for r in manifest.groupBy("part").agg(F.sum("documents").alias("n")).collect()]
    assert sum(parts) == len(rows) and max(parts) < 3 * len(rows) / len(parts)
    got = token_store.read(manifest).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    tokenizer = Tokenizer.from_file(WORD)
    crc = {t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in {t for _, t in rows}}
    assert multiset((r.doc_id, r.ids_crc32) for r in got) == multiset((d, crc[t]) for d, t in rows)
