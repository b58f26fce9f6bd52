"""The pipeline's stages in a row, against brute force."""

from fractions import Fraction

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lacewing.llm import quality

from .fixtures import documents, frame, multiset
from .test_documents import lines_by_definition, quality_by_definition, sha
from .test_pairs import brute


def test_stages_and_run(spark, tmp_path):
    rows = [(i, t) for i, t in dict(r for r in documents(13, 120) if r[0] is not None).items()]
    items = [(1, " ".join(max((t for _, t in rows if t), key=len).split()[20:60])), (2, " ".join([t for _, t in rows if t and len(t.split()) > 140][3].split()[5:70]))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    full = [quality_by_definition(t) for _, t in rows]
    limits = lambda m, t: m[0] >= 50 and 100 * m[4] <= 50 * m[0] and 10 * m[2] <= m[0] and 2 * m[0] <= m[1] <= 25 * m[0] and 10 * m[3] <= 5 * len([x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")])
    step = [r for r, m in zip(rows, full, strict=True) if limits(m, r[1])]
    assert len(quality.POLICIES["v2"]) == 6 and 10 < len(step) < len(rows)
    step = [(d, t) for d, t, n, g in lines_by_definition(step) if not (g and g == n)]
    step = [r for r, b in zip(step, brute(step, 5, Fraction(4, 5)), strict=True) if b[2] == r[0]]
    from .test_pairs import LOWER
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(cut(x)[a : a + 13]) for _, x in items for a in range(len(cut(x)) - 12)}
    kept = []
    for d, t in step:
        w = cut(t)
        hit = {a + k for a in range(len(w) - 12) if tuple(w[a : a + 13]) in windows for k in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append((d, t))
    assert len(kept) < len(step)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t)))
    assert multiset(map(tuple, got)) == multiset(want)
