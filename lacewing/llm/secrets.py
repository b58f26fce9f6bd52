"""Secret scan: fixed patterns, and character Markov models for what they miss.

Two first-order character models, one of random strings and one of ordinary
identifiers, score every run of identifier characters, of whatever length; where
the log-likelihood ratio for "random" exceeds a threshold, the run is reported
as kind ``markov``. Both models are trained from labelled samples. Random
strings are what the fixed patterns found in the sampled documents, and strings
drawn over the usual secret alphabets; ordinary ones are the sampled documents'
other runs, and identifiers composed of their words. The threshold lies midway
between the highest ratio of an ordinary string that was held out and nearly the
lowest of a random one.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import CHUNK_BYTES, column_bytes

#: Bounds of the labelled sample: documents that lend words, words kept, strings of each label.
SAMPLE_DOCS = 2000
SAMPLE_WORDS = 20_000
SAMPLE_STRINGS = 20_000
#: Share of the labelled strings that are held out, and the share of random ones that may fall below the threshold's lower mark.
HELD_OUT, LOWEST = 0.25, 0.002

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_IN_RUN = np.zeros(256, bool)
_IN_RUN[[ord(c) for c in map(chr, range(128)) if _RUN.match(c)]] = True
_ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed kinds, by start and then by kind as listed."""
    found = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a maximal run of 32 or more is what the unbounded pattern keeps after its length test
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _symbols(token: str) -> np.ndarray:
    return np.frombuffer(token.encode("ascii"), np.uint8)


@dataclass(frozen=True)
class MarkovRatio:
    """Log-likelihood ratio, random against ordinary, of character transitions."""

    table: np.ndarray  # [128, 128] float64; row 0 starts a run
    threshold: float = 0.0  # nats above which a run is reported

    @staticmethod
    def fit(random_strings: list[str], ordinary: list[str]) -> MarkovRatio:
        logs = []
        for strings in (random_strings, ordinary):
            counts = np.full((128, 128), 0.05)
            # one array for all strings: each string's start symbol stands before it, and moves into it don't count
            c = _symbols("".join("\0" + s for s in strings))
            into = c[1:] != 0
            np.add.at(counts, (c[:-1][into], c[1:][into]), 1.0)
            logs.append(np.log(counts / counts.sum(1, keepdims=True)))
        return MarkovRatio(logs[0] - logs[1])

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, ratio) of each run in adjacent texts; ``ends`` are the texts' boundaries, from 0 on."""
        inside = _IN_RUN[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[ends[:-1]] = True
        first = inside & (~np.append(False, inside[:-1])[: len(data)] | begins[:-1])
        last = inside & (~np.append(inside[1:], False)[: len(data)] | begins[1:])
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            return starts, stops, np.zeros(0)
        at = np.flatnonzero(inside)
        before = np.where(first[at], 0, data[at - 1]).astype(np.int64)  # a first byte's neighbour isn't looked at
        ratios = np.add.reduceat(self.table.ravel()[before * 128 + data[at]], np.searchsorted(at, starts))
        return starts, stops, ratios

    def reported(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(text, start, stop) of each reported run, in bytes of its text."""
        data, offsets = column_bytes(column)
        at, n = 0, len(offsets) - 1
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1))
            ends = offsets[at : to + 1] - offsets[at]
            starts, stops, ratios = self.runs(data[offsets[at] : offsets[to]], ends)
            hit = np.flatnonzero(ratios > self.threshold)
            text = np.searchsorted(ends, starts[hit], "right") - 1
            yield from zip((text + at).tolist(), (starts[hit] - ends[text]).tolist(), (stops[hit] - ends[text]).tolist(), strict=True)
            at = to

    def scores(self, strings: list[str]) -> np.ndarray:
        """The ratio of each string, a single run."""
        data = _symbols("".join(strings))
        return self.runs(data, np.cumsum([0, *map(len, strings)]))[2]


def labelled_samples(found: list[str], plain: list[str], seed: int = 20240229) -> tuple[list[str], list[str]]:
    """(random strings, ordinary strings), shuffled: those found in documents, and as many made up as SAMPLE_STRINGS of each."""
    rng = random.Random(seed)
    words = sorted({w for w in plain if w.isalnum() and not w.isdigit()}) or ["value", "index", "name", "file"]
    secret = ["".join(rng.choices(rng.choice(_ALPHABETS), k=rng.randint(16, 48))) for _ in range(SAMPLE_STRINGS)]
    ordinary = []
    for _ in range(SAMPLE_STRINGS):
        parts = [rng.choice(words) for _ in range(rng.randint(2, 6))]
        shape = rng.random()
        if shape < 0.3:
            ordinary.append("_".join(parts))
        elif shape < 0.5:
            ordinary.append("".join(p[:1].upper() + p[1:] for p in parts))
        elif shape < 0.7:
            ordinary.append("-".join(parts) + "-" + str(rng.randint(0, 2030)))
        elif shape < 0.8:
            ordinary.append("/".join(parts))
        elif shape < 0.9:
            ordinary.append("".join(rng.choices("0123456789", k=rng.randint(1, 20))))
        else:
            ordinary.append("".join(parts).upper() if rng.random() < 0.5 else rng.choice("-_=+/") * rng.randint(1, 60))
    secret, ordinary = secret + found, ordinary + plain
    rng.shuffle(secret)
    rng.shuffle(ordinary)
    return secret, ordinary


def learn(secret: list[str], ordinary: list[str]) -> tuple[MarkovRatio, float, float]:
    """(model, share of held-out random strings it reports, share of held-out ordinary ones)."""
    a, b = (int(len(x) * (1 - HELD_OUT)) for x in (secret, ordinary))
    model = MarkovRatio.fit(secret[:a], ordinary[:b])
    # the threshold is set on one half of what is held out, midway between the labels, and judged on the other
    mid_a, mid_b = a + (len(secret) - a) // 2, b + (len(ordinary) - b) // 2
    low, high = float(np.quantile(model.scores(secret[a:mid_a]), LOWEST)), float(model.scores(ordinary[b:mid_b]).max())
    model = MarkovRatio(model.table, max(0.0, (low + high) / 2))
    return model, float((model.scores(secret[mid_a:]) > model.threshold).mean()), float((model.scores(ordinary[mid_b:]) > model.threshold).mean())


def sampled_strings(texts: list[str]) -> tuple[list[str], list[str]]:
    """(values of the fixed patterns, the other runs) in the texts; each string once."""
    found, plain = set(), set()
    for t in texts:
        spans = base_spans(t)
        for m in _RUN.finditer(t):
            if any(s < m.end() and m.start() < e for _, s, e in spans):
                found.update([m[0]] if len(m[0]) >= 16 else [])
            else:
                plain.add(m[0])
    return sorted(found - plain), sorted(plain)


def train(docs: DataFrame) -> tuple[MarkovRatio, float, float]:
    """The model, and the shares of random and of ordinary strings held out that it reports.

    Strings come from at most SAMPLE_DOCS documents, those with the smallest
    hash of id and text, and SAMPLE_WORDS of each label; the bounds keep the
    training set on the driver small.
    """
    docs = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("k"), docs["text"].cast("string").alias("t"))
    smallest = [r.k for r in docs.select("k").distinct().orderBy("k").limit(SAMPLE_DOCS).collect()]
    if not smallest:
        return learn(*labelled_samples([], []))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, plain = sampled_strings([t for t in b.column(0).to_pylist() if t])
            yield pa.RecordBatch.from_arrays([pa.array(found + plain, pa.string()), pa.array([True] * len(found) + [False] * len(plain), pa.bool_())], names=["s", "found"])

    # what one document shows as an ordinary run is ordinary everywhere
    picked = docs.filter(F.col("k") <= max(smallest)).select("t").mapInArrow(strings, "s string, found boolean").groupBy("s").agg(F.min("found").alias("found"))
    kept = {f: [r.s for r in picked.filter(F.col("found") == f).orderBy(F.xxhash64("s"), "s").limit(SAMPLE_WORDS).collect()] for f in (True, False)}
    return learn(*labelled_samples(kept[True], kept[False]))


def all_spans(texts: list[str], model: MarkovRatio) -> list[list[tuple[str, int, int]]]:
    """Each text's spans: those of the fixed kinds, and the reported runs that none of them touches."""
    found = [base_spans(t) for t in texts]
    order = (*KINDS, "markov")
    for i, start, stop in model.reported(pa.array(texts, pa.string())):
        t = texts[i]
        if not t.isascii():
            start = len(t.encode("utf-8")[:start].decode("utf-8"))
            stop = start + len(t.encode("utf-8")[:stop].decode("utf-8")[start:])
        if not any(k != "markov" and s < stop and start < e for k, s, e in found[i]):
            found[i].append(("markov", start, stop))
    return [sorted(spans, key=lambda s: (s[1], order.index(s[0]))) for spans in found]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: MarkovRatio | None = None) -> DataFrame:
    """One row per input row with the base counts, their digest, and all spans.

    Positions are code points, ends exclusive. Defined results: a null text is
    empty (no spans, the digest of the empty string); a null doc_id stays null;
    repeated rows are scanned each; an empty table gives no rows; columns other
    than doc_id and text, whatever their names, are not read. No text is cut,
    however long: each is scanned whole.
    """
    model = model or train(docs)[0]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, spans in zip(b.column(0).to_pylist(), all_spans(texts, model), strict=True):
                base = [s for s in spans if s[0] != "markov"]
                row = (i, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(scanned, SCHEMA)
