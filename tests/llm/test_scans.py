"""Licence scan, filter audit and collocations against plain definitions, with nulls, ties, repeats, long and empty texts."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from lacewing.llm import collocations, filter_audit, licenses, wordspans
from lacewing.llm.store import Workspace

from .fixtures import documents, frame, multiset

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, r long, t int, w string, label string, fails string, part string, n long, phrase string"


def table(spark, rows, partitions=3):
    """(doc_id, text, lang) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*x, 1, 2, "w", "l", "f", "p", 3, "q") for x in rows], SCHEMA).repartition(partitions)


# -- licences


def licences_by_definition(text):
    words = PLAIN.findall((text or "").translate(LOWER))
    base, labels, base_labels, score = [], set(), set(), 0.0
    for t in licenses.TEMPLATES:
        key = t.key.split()
        for i in range(len(words) - len(key) + 1):
            if words[i : i + len(key)] != key:
                continue
            at = i - t.key_at
            matched = sum(0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(t.words))
            if t.base:
                base.append(i)
                base_labels.add(t.label)
            elif 2 * matched < len(t.words):
                continue
            labels.add(t.label)
            score = max(score, matched / len(t.words))
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


def licence_texts():
    rng = random.Random(5)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.words})
    texts = [t.text for t in licenses.TEMPLATES] + [t.key.upper() for t in licenses.TEMPLATES]
    texts += ["CC BY CC BY-NC 4.0 cc--by, c c by", "all rights reserved " * 300, "General Public\nLicense general public licence", "ccby all rights", "K rights reserved. all Rights\x00Reserved é"]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 200))) for _ in range(40)]
    texts += [" ".join(rng.choice(["all rights reserved", "cc by", "public license", "mit license", "the", "x"]) for _ in range(30)) for _ in range(20)]
    return texts


def test_licences_are_found_as_defined(spark):
    rows = [(i, t, "en") for i, t in enumerate(licence_texts())] + [(*x, None) for x in documents(4, 30)]
    got = [tuple(r) for r in licenses.scan(table(spark, rows)).collect()]
    assert multiset(got) == multiset((d, *licences_by_definition(t)) for d, t, _ in rows)
    # a whole template has every word in its place
    assert all(licences_by_definition(t.text)[-1] == 1.0 for t in licenses.TEMPLATES)


def test_a_long_file_with_the_licence_at_its_end(spark):
    text = "the public may license this and all of the software " * 4000 + "Released under the MIT License. All rights reserved."
    row = licenses.scan(table(spark, [(1, text, "en")])).first()
    assert tuple(row)[1:] == licences_by_definition(text) and row.labels == "mit,reserved" and row.n_base == 1


def test_templates_name_their_key_phrase():
    with pytest.raises(ValueError):
        licenses.Template("x", "one two three", "two four").key_at
    assert licenses.Template("x", "a b a c", "a c").key_at == 2


# -- filter audit


def audit_by_definition(rows, labels):
    firsts = {}
    for d, t, _ in rows:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > firsts[t]]
        mine = [x for x in labels if d is not None and x[0] == d]
        docs.append((lang or "", dict(zip("ABCDE", fails, strict=True)), any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        steps, total = [], Counter()
        for p in permutations("ABCDE"):
            for s, f in enumerate(p):
                alive = [d for d in own if not any(d[1][g] for g in p[:s])]
                bad = [d for d in alive if d[1][f]]
                total[f] += len(bad)
                redundant = sum(d[1][f] for d in own) - len(bad)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                steps.append((part, "".join(p), s + 1, len(alive) - len(bad), len(bad), redundant, alone, sum(d[2] for d in bad), sum(d[3] for d in bad), f))
        out += [(*x[:-1], total[x[-1]]) for x in steps]
    return out


def test_audit_counts_as_defined(spark):
    rng = random.Random(2)
    rows = [(d, t, rng.choice(["en", "de", "", None])) for d, t in documents(3, 60)]
    rows += [(900 + i, rng.choice(["SHOUT NOW", "a # b", "b", "é" * 200, "Ab c d e f"]) + " w" * rng.choice([0, 1, 99, 150]), "fr") for i in range(60)]
    rows += [(800 + i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([99, 100, 101, 300]))) + rng.choice(["", " |", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 10]), "fr") for i in range(60)]
    rows += [rows[-1], rows[-1], (None, rows[-1][1], "fr"), (None, rows[-1][1], None)]
    ids = [d for d, _, _ in rows if d is not None]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for d in rng.sample(ids, len(ids) // 2)] + [(ids[0], 1, 1), (ids[0], 0, 0), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(table(spark, rows), marks).collect()]
    assert multiset(got) == multiset(audit_by_definition(rows, labels))


def test_audit_of_a_hot_text_and_a_long_one(spark):
    rows = [(i, "copy of one text", "en") for i in range(3000)] + [(5000, " ".join(f"w{i}" for i in range(50_000)), "en")]
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(table(spark, rows, 6), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got["EABCD", 1].removed == 2999 and got["EABCD", 2].removed == 1 and got["EABCD", 5].kept == 1 and got["ABCDE", 5].redundant == 2999


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    texts = ["a b c a", "", "x", "b b", "é e"]
    monkeypatch.setattr(wordspans, "span_hashes", lambda data, starts, stops: np.zeros(len(starts), np.uint64))
    (_, data, ends), = wordspans.chunks(pa.array(texts))
    spans = wordspans.word_spans(data != 0x20, ends)
    assert wordspans.distinct_per_text(data, *spans).tolist() == [3, 0, 1, 1, 2]
    number, first = wordspans.numbered_words(data, *spans[:2], np.zeros(len(spans[0]), np.uint64))
    words = [w for t in texts for w in t.split()]
    assert len(first) == len(set(words)) and [words[first[n]] for n in number] == words


# -- collocations


def phrases_by_definition(rows, least, top):
    counts, totals = Counter(), Counter()
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang if lang is not None else "und"] += len(w)
            counts.update((lang if lang is not None else "und", *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {p: n for p, n in counts.items() if n >= least and len(p) > 2}
    out = {}
    for p, a in found.items():
        inside = [x for x, f in found.items() if x[0] == p[0] and len(x) > len(p) and 100 * f >= 80 * a and any(x[i : i + len(p) - 1] == p[1:] for i in range(1, len(x) - len(p) + 2))]
        if inside:
            continue
        cuts = [(2_000_000 * a // (counts[p[: k + 1]] + counts[p[:1] + p[k + 1 :]]), k, counts[p[: k + 1]], counts[p[:1] + p[k + 1 :]]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top])]


def phrase_rows():
    rng = random.Random(8)
    vocabulary = ["a", "B", "c", "é", "日本", "z", "Long-word", "x#", "it's", "q"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", "\n", ". ", ", ", "\r"]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "de", None, "und", "", "a b"])) for i in range(70)]
    return rows + [(*x, "en") for x in documents(6, 20)] + [(None, None, "en"), (1, "!?", "fr"), (2, "only one", "fr")]


@pytest.mark.parametrize("least, top", [(4, 2000), (3, 7)])
def test_phrases_as_defined(spark, least, top):
    rows = phrase_rows()
    got = [tuple(r) for r in collocations.mine(table(spark, rows), least=least, top=top).collect()]
    assert multiset(got) == multiset(phrases_by_definition(rows, least, top)) and len({x[0] for x in got}) > 2


def test_bits_decide_what_is_counted_only(spark, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)  # every bit is set: nothing is left out
    assert multiset(map(tuple, collocations.mine(table(spark, rows), least=4).collect())) == multiset(phrases_by_definition(rows, 4, 2000))


def test_bits_leave_out_what_is_rare(spark):
    rows = phrase_rows()
    ws = Workspace(spark, "t")
    _, found = collocations.levels(table(spark, rows), ws, 4)
    bits = collocations.frequent_bits(found[0])
    assert [len(r.phrase.split(" ")) for r in found[2].collect()] == [3] * found[2].count()
    assert all(collocations.frequent_bits(x).has(np.array([r.print for r in collocations._prints(x).collect()], np.int64).view(np.uint64)).all() for x in found)
    assert bits.has(np.random.default_rng(0).integers(0, 1 << 63, 4000).astype(np.uint64)).mean() < 0.01


def test_long_texts_are_cut_after_breaks_only(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab ", "cd ", "ef, ", "gh. "]) for _ in range(3000)), "no breaks " * 900, "", "end"]
    want = phrases_by_definition([(0, t, "en") for t in texts], 20, 2000)
    whole = collocations._pieces(*wordspans.column_bytes(pa.array(texts)))
    assert sum(len(d) for _, d, _ in whole) == sum(map(len, texts))
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 500)
    cut = list(collocations._pieces(*wordspans.column_bytes(pa.array(texts))))
    assert len(cut) > 10 and b"".join(d.tobytes() for _, d, _ in cut) == "".join(texts).encode()
    codes = np.zeros(4, np.int64)
    for k in (1, 2):
        seen = Counter()
        every = collocations.Bits(np.full(1, -1, np.int64).view(np.uint64))
        for at, piece, ends in cut:
            found = collocations._grams(piece, ends, codes[at : at + len(ends) - 1], np.zeros(len(ends) - 1, np.uint64), k, every)
            if found:
                seen.update(dict(zip(found[1].to_pylist(), found[2].tolist(), strict=True)))
        for t in [x for x in want if len(x[2].split()) == k]:
            assert seen[t[2]] == t[3]
        assert sum(seen.values()) == sum(max(0, len(p.split()) - k + 1) for t in texts for p in re.split("[.,]", t))


def test_empty_tables(spark):
    df = table(spark, [])
    assert licenses.scan(df).count() == filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == collocations.mine(df).count() == 0
    assert frame(spark, []).count() == 0
