"""Operators on single documents, and those that join them with others, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from lacewing.llm import bpe, decontaminate, hmm, linededup, quality, secrets, sharding, substring_dedup, token_store
from lacewing.llm.store import Workspace

from .fixtures import documents, frame, multiset
from .test_pairs import LOWER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -- sharding


def test_shards_are_near_equal_and_gapless(spark):
    rows = documents(4, 300)
    got = sharding.shard(frame(spark, rows), 7).collect()
    assert multiset((r.doc_id, r.size, r.text_crc32) for r in got) == multiset((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for k in range(7):
        assert sorted(r.slot for r in by[k]) == list(range(len(by[k])))
        assert abs(sum(r.size for r in by[k]) - total / 7) <= 2 * largest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_a_hot_group_of_copies_is_divided(spark):
    rows = [(i, "the same text " * 9) for i in range(900)] + [(1000 + i, f"text {i} " * 11) for i in range(900)]
    sizes = collections.Counter()
    for r in sharding.shard(frame(spark, rows), 10).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 500 and len(sizes) == 10


# -- secrets


def base_by_definition(text):
    out = []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for _, _, s in sorted(out)]


def test_base_spans_are_as_defined(spark):
    odd = ["api_key= 'abcdefgh1234' é ApIkEy:short", "paſſword=abcdefghijk", "toKen=abcdefghijk", 'Password" : "0123456789abcdef0123456789abcdef"', "AKIA" + "A" * 11 + " AKIA" + "B1" * 6, "f" * 31 + "g" + "e" * 32, "ß" * 5 + "SECRET=aaaaaaaa", "secret=token=abcdefgh12"]
    rows = [(i, t) for i, t in enumerate(odd)] + documents(5, 20)
    model = secrets.MarkovRatio(np.zeros((128, 128)))
    for r in secrets.scan(frame(spark, rows), model).collect():
        assert r.base_sha256 in {sha(",".join(base_by_definition(t or ""))) for d, t in rows if d == r.doc_id}
    for t in odd:
        assert [f"{k}:{a}:{z}" for k, a, z in secrets.base_spans(t)] == base_by_definition(t)


def test_models_tell_random_strings_from_identifiers(spark):
    rows = [(i, "some ordinary words stand here, over and over again, with names and values of things") for i in range(30)] + documents(5, 20)
    model, caught, wrong = secrets.train(frame(spark, rows))
    assert caught > 0.97 and wrong < 0.001
    key = "wJ4r7XUtnFEMIK7MDENGbPx8fiCYQz3kLp0"
    text = f"the value is {key} and so on, unlike some_long_name_of_a_value_2020 or {'-' * 40}"
    at = text.index(key)
    inside = f"token={key}"
    odd = f"日本 é {key}"
    assert secrets.all_spans([text, inside, "", odd], model) == [[("markov", at, at + len(key))], [("assign", 0, len(inside))], [], [("markov", 5, 5 + len(key))]]


# -- decontamination


def test_contamination_equals_brute_force(spark):
    rows = documents(6, 60)
    rows += [(901, f"{' '.join(rows[2][1].split()[:1])} " + "filler words " * 200 + " ".join(f"k{i}" for i in range(13)))]
    long_texts = [t for _, t in rows if t and len(t) > 200]
    pick = lambda t, a, z: " ".join(re.split(r"\s+", t)[a:z])
    items = [(1, pick(long_texts[0], 3, 30)), (2, pick(long_texts[1], 5, 18).upper()), (10, pick(long_texts[2], 0, 9)), (11, "one two"), (12, ""), (13, None), (14, "onlyhere"), (None, pick(long_texts[3], 2, 40)), (1, pick(long_texts[0], 3, 30)), (16, " ".join(f"K{i}" for i in range(13))), (15, "nothing of this is anywhere " * 4)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    want = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for i, x in items:
            v = cut(x)
            k = min(13, len(v))
            windows = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if v else set()
            for a in range(len(w) - k + 1):
                if v and tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= {str(i)} if i is not None else set()
        want.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [tuple(r)[:1] + tuple(r)[2:] for r in decontaminate.contamination(frame(spark, rows), bench).collect()]
    assert multiset(got) == multiset(want) and any(x[5] for x in want) and any(x[2] and not x[5] for x in want)
    df = frame(spark, rows)
    clean = decontaminate.clean_documents(df, bench)
    bad = {(d, t) for (d, t), x in zip(rows, want, strict=True) if x[5]}
    assert clean.columns == df.columns
    assert multiset((r.doc_id, r.text) for r in clean.collect()) == multiset(x for x in rows if x not in bad)


def test_contamination_without_items_or_documents(spark):
    rows = documents(6, 5)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r.items_sha256 == EMPTY and not r.contaminated for r in decontaminate.contamination(frame(spark, rows), none).collect())
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, []), some).count() == 0


# -- language model


def test_scores_equal_definition_and_forward_is_exact(spark):
    rows = documents(7, 60)
    got = hmm.score(frame(spark, rows)).collect()
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = [(d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows]
    assert multiset((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == multiset(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_rare_words_take_the_join(spark, monkeypatch):
    rows = documents(7, 30)
    key = lambda rs: multiset((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in rs)
    whole = key(hmm.score(frame(spark, rows)).collect())
    monkeypatch.setattr(hmm, "HEAD", 5)
    assert key(hmm.score(frame(spark, rows)).collect()) == whole


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    start, moves, emits = (x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 9))))
    model = hmm.Model(start, moves, emits)
    lengths = [1, 4, 2, 5]
    offsets = np.cumsum([0, *lengths])
    classes = rng.integers(0, 7, offsets[-1])
    log = hmm.log_likelihood(model, classes, offsets)
    counts = hmm.expected_counts(model, classes, offsets)
    e_moves = np.zeros((3, 3))
    e_start = np.zeros(3)
    for k, n in enumerate(lengths):
        x = classes[offsets[k] : offsets[k + 1]]
        paths = {}
        for s in itertools.product(range(3), repeat=n):
            p = start[s[0]] * emits[s[0], x[0]]
            for a, b, y in zip(s, s[1:], x[1:], strict=False):
                p *= moves[a, b] * emits[b, y]
            paths[s] = p
        total = sum(paths.values())
        assert math.isclose(math.log10(total), log[k], rel_tol=1e-9)
        for s, p in paths.items():
            e_start[s[0]] += p / total
            for a, b in zip(s, s[1:], strict=False):
                e_moves[a, b] += p / total
    assert np.allclose(counts[:3], e_start) and np.allclose(counts[3:12].reshape(3, 3), e_moves)
    assert math.isclose(counts[-1], log.sum(), rel_tol=1e-9) and math.isclose(counts[12:-1].sum(), offsets[-1])


def test_baum_welch_raises_likelihood_and_beats_the_base_on_held_out(spark):
    rng = np.random.default_rng(3)
    kinds = [[f"{p}{k}" for k in range(80)] for p in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 60))) for i in range(300)]
    df = frame(spark, rows)
    got = [r for r in hmm.score(df).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# -- quality


def quality_by_definition(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measurements_equal_definition(spark):
    rows = [*documents(8, 60), (900, "a b\na b\n \na b\nc | # <"), (901, "x y z x y z x y"), (902, " em space \x1c sep\x85")]
    got = quality.ledger(frame(spark, rows)).collect()
    assert multiset((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == multiset((d, *quality_by_definition(t)) for d, t in rows)
    for r in got:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.failed & 3 != 0) == base


def test_policies_and_ablation_are_bitwise(spark):
    rows = documents(8, 60)
    ledger = quality.ledger(frame(spark, rows)).cache()
    kept = quality.kept_documents(frame(spark, rows), "v2")
    want = [r.doc_id for r in ledger.collect() if r.failed & quality.mask("v2") == 0]
    assert multiset(r.doc_id for r in kept.collect()) == multiset(want) and kept.columns == frame(spark, rows).columns
    masks = [r.failed for r in ledger.collect()]
    for r in quality.ablation(ledger, "v2").collect():
        own, full = quality.bit(r.rule), quality.mask("v2")
        assert r.rejected == sum(m & own != 0 for m in masks)
        assert r.kept_without == sum(m & full & ~own == 0 for m in masks)
        assert r.rejected_alone == sum(m & full == own for m in masks)


# -- BPE


ODD = ["", "hello  world\n\n x'll <|endoftext|>don't  ", "a\x1c\x1d b\x85c d  e", "日本語テキスト🙂🙂 ñandú", "x" * 700, "<|endoftext|><|startoftext|>", "½Ⅷ٣ 12345678901234567890123456789012345678901", "a​b́ é", "'S'T 'RE", "ſ İ ΑΣ Σ"]


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = documents(9, 20) + [(500 + i, t) for i, t in enumerate(ODD)]
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert multiset(map(tuple, bpe.round_trip(frame(spark, rows), path).collect())) == multiset(want)


def test_segment_trees_agree():
    b = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [t.encode() for _, t in documents(9, 20) if t] + [b"aaaaaaaaaaaaaaaa", b"z", " température".encode()]
    short = [p[:32] for p in pieces]
    assert b.encode_pieces(short) == [b.encode_one(p) for p in short]
    assert all(b"".join(b.bytes_of[i] for i in b.encode_one(p)) == p for p in pieces)
    tree = bpe.SegmentTree([3, 1, 2, 1])
    assert tree.lowest() == (1, 1)
    tree.update(1, float("inf"))
    assert tree.lowest() == (1, 3)


# -- substring dedup


def removed_by_definition(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    order = lambda d: float("inf") if d is None else d
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, float("inf")), order(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < order(d) for k in range(13)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


@pytest.mark.parametrize("hot", [50_000, 0])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    rows = documents(10, 90)
    want = removed_by_definition(rows)
    assert multiset(map(tuple, substring_dedup.dedup(frame(spark, rows)).collect())) == multiset(want)
    assert sum(0 < x[2] < x[1] for x in want) > 5
    assert substring_dedup.dedup(frame(spark, [])).count() == 0


def test_fm_index_counts_and_finds_the_smallest_owner():
    rng = np.random.default_rng(2)
    body = rng.integers(2, 6, 400)
    text = np.append(np.append(body, 1), 0)
    owner = rng.integers(0, 50, len(text))
    index = substring_dedup.FMIndex(text, owner)
    ends = np.arange(4, 400)
    got, low, high = index.matches(text, ends, 4)
    least = index.owners.least(low, high)
    for e, g, a, z, m in zip(ends.tolist(), got.tolist(), low.tolist(), high.tolist(), least.tolist(), strict=True):
        pattern = text[e - g : e].tolist()
        where = [i for i in range(len(text) - g + 1) if text[i : i + g].tolist() == pattern]
        assert z - a == len(where) and m == owner[where].min() and (g == 4 or len(where) == 1)


# -- line dedup


def lines_by_definition(rows):
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    seen, out = {}, {}
    for k in sorted(range(len(rows)), key=key):
        lines = (rows[k][1] or "").split("\n")
        used = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for j in range(len(used) - 2):
            w = tuple(lines[used[j + m]] for m in range(3))
            if seen.setdefault(w, (rows[k], j)) != (rows[k], j):
                gone |= {used[j], used[j + 1], used[j + 2]}
        out[k] = (rows[k][0], rows[k][1] if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(used), len(gone))
    return list(out.values())


def test_line_dedup_equals_brute_force(spark):
    rows = documents(11, 60)
    rows = [r for r in rows if r != (rows[5][0], "same id, other text " * 5)]
    rows += [(700, "a\nb\n\nc\nd\na\nb\nc\nend"), (701, "x\na\n\nb\nc\ny"), (702, "a\nb\nc"), (703, "a\nb"), (704, "a\nb\nc"), (None, "a\nb\nc\nmore")]
    got = linededup.dedup(frame(spark, rows)).collect()
    assert multiset((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == multiset(lines_by_definition(rows))
    df = frame(spark, rows)
    left = linededup.deduped_documents(df)
    assert left.columns == df.columns
    assert multiset((r.doc_id, r.text) for r in left.collect()) == multiset((d, t) for d, t, n, g in lines_by_definition(rows) if not (g and g == n))
    assert linededup.dedup(frame(spark, [])).count() == 0


# -- token files


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_TOKENS", 900)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = documents(12, 40) + [(500 + i, t) for i, t in enumerate(ODD)]
    ws = Workspace(spark, "t")
    manifest = token_store.write(frame(spark, rows), ws.path("f"), path, 2, ws)
    got = token_store.read(manifest).collect()
    ids = {(d, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert multiset((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == multiset((d, len(ids[d, t]), crc(ids[d, t])) for d, t in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1].tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and all(r.doc_id is None for r in ordered[: len(ordered) - len(known)])
    assert manifest.count() > 4


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], [7, 7, 1 << 40], np.sort(rng.integers(0, 100_000, 3000)).tolist(), list(range(1000))):
        data = token_store.EliasFano.encode(np.array(values, np.int64)).to_bytes()
        back = token_store.EliasFano.from_bytes(memoryview(data))
        assert back.get(np.arange(len(values))).tolist() == values
        if len(values) > 100:
            assert len(data) * 8 < len(values) * (2.2 + math.log2(max(1, values[-1] / len(values)))) + 400
