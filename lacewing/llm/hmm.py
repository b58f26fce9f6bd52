"""Hidden Markov language model over words and word classes.

Latent states emit classes. Each frequent word is a class of its own, as many as
the training texts have (up to OWN); the others share classes by a hash, and a
class emits its words by their corpus counts, so the tables that travel are of
bounded size while every word's count is used. Baum-Welch: each partition
computes expected transition and emission counts of its whole sequences, Spark
sums them, and the next round starts from the sums, until the likelihood hardly
grows. The scaled forward recursion then gives the exact likelihood of each
whole token sequence.

Word counts stay distributed. The most frequent HEAD words travel to the tasks
as one table of fixed size; the rest meet their counts in a join by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_unique
from .store import Workspace
from .wordhash import signed, word_hashes

STATES = 6
CLASS_BITS = 12
SHARED = 1 << CLASS_BITS  # classes of the words that have none of their own
END_CLASS = SHARED  # the end token's; frequent words' classes follow
#: Words with as many training occurrences have a class of their own, the most frequent OWN of them.
OWN_COUNT, OWN = 50, 1 << 14
#: Baum-Welch ends when a round lets the log-likelihood grow by less than this share. Going on to 1e-4
#: takes some three times the rounds on the test tables, for a log-likelihood 0.1 % nearer to zero.
ENOUGH = 5e-4
#: One training row in so many, chosen by hash, finds a start for all of them.
WARM = 8
#: Long sequences are worked on in stretches of this many tokens side by side; the counts are those of the whole sequence.
PIECE = 768
#: Words whose counts travel to every task.
HEAD = 1 << 17
#: Tokens that a task works on at once.
BATCH = 800_000
END = np.uint64(0xE0D0_0000_0000_0E0D)
#: Pseudo-counts that pull each state's emissions and transitions to the corpus's.
EMIT_PRIOR, MOVE_PRIOR = 200.0, 1.0


def classes_of(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Each token's class; ``own`` are the words with a class of their own, sorted."""
    out = ((words >> np.uint64(40)) & np.uint64(SHARED - 1)).astype(np.uint16)
    if len(own):
        place = np.minimum(np.searchsorted(own, words), len(own) - 1)
        mine = own[place] == words
        out[mine] = (END_CLASS + 1 + place[mine]).astype(np.uint16)
    out[words == END] = END_CLASS
    return out


def tokens_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token hashes, offsets): each text's lower-cased words and then one end."""
    for at, words, offsets in word_hashes(column, lower=True):
        n = len(offsets) - 1
        out = np.empty(len(words) + n, np.uint64)
        ends = offsets[1:] + np.arange(n)
        is_end = np.zeros(len(out), bool)
        is_end[ends] = True
        out[is_end] = END
        out[~is_end] = words
        yield at, out, offsets + np.arange(n + 1)


@dataclass(frozen=True)
class Model:
    """Probabilities: start [S], moves [S, S], emits [S, classes]."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @staticmethod
    def initial(class_share: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """Sticky states whose emissions are the corpus's, each bent by its own random factors."""
        rng = np.random.default_rng(seed)
        emits = class_share * rng.gamma(2.0, 0.5, (states, len(class_share)))
        moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))

    @staticmethod
    def from_counts(counts: np.ndarray, class_share: np.ndarray, states: int = STATES) -> Model:
        start = counts[:states] + 1.0
        moves = counts[states : states + states * states].reshape(states, states) + MOVE_PRIOR
        emits = counts[states + states * states :].reshape(states, -1) + EMIT_PRIOR * class_share
        return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


def _time_major(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes by step, first place of each step, sequences alive at each step, order of the sequences)."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max(initial=0))
    alive = np.searchsorted(-lengths[order], -np.arange(steps), "left")
    first = np.concatenate([[0], np.cumsum(alive)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    step = np.arange(len(classes)) - np.repeat(offsets[:-1], lengths)
    out = np.empty(len(classes), np.int64)
    out[first[step] + np.repeat(rank, lengths)] = classes
    return out, first, alive, order


def log_likelihood(model: Model, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence, by the scaled forward recursion."""
    by_step, first, alive, order = _time_major(classes, offsets)
    emit = np.ascontiguousarray(model.emits.T)
    total = np.zeros(len(offsets) - 1)
    a = np.zeros((0, len(model.start)))
    for t in range(len(alive)):
        n = alive[t]
        e = emit[by_step[first[t] : first[t + 1]]]
        a = model.start * e if t == 0 else (a[:n] @ model.moves) * e
        scale = a.sum(1)
        a /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty_like(total)
    out[order] = total
    return out


def _cut(offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets with further cuts, so that no piece is longer than ``most``; each piece's number in its sequence)."""
    lengths = np.diff(offsets)
    n = np.maximum(1, -(-lengths // most))
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.append(np.repeat(offsets[:-1], n) + number * most, offsets[-1]), number


def _carried(model: Model, classes: np.ndarray, offsets: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the state distribution before its first token, and the direction of the backward vector at its end.

    Pieces of a longer sequence are summed up as matrices, side by side; only
    these are multiplied along the sequence.
    """
    s, n = len(model.start), len(number)
    before, after = np.tile(model.start, (n, 1)), np.ones((n, s))
    joined = np.append(number[1:] > 0, False)  # the next piece goes on with the sequence
    part = np.flatnonzero(joined | (number > 0))
    if not len(part):
        return before, after
    lengths = np.diff(offsets)[part]
    flat = np.concatenate([classes[a : a + z] for a, z in zip(offsets[part].tolist(), lengths.tolist(), strict=True)])
    by_step, first, alive, order = _time_major(flat, np.concatenate([[0], np.cumsum(lengths)]))
    emit = np.ascontiguousarray(model.emits.T)
    through = np.empty((len(part), s, s))
    for t in range(len(alive)):
        e = emit[by_step[first[t] : first[t + 1]]]
        through[: alive[t]] = np.eye(s) * e[:, None, :] if t == 0 else (through[: alive[t]].reshape(-1, s) @ model.moves).reshape(-1, s, s) * e[:, None, :]
        if t % 16 == 15:
            through[: alive[t]] /= through[: alive[t]].sum((1, 2))[:, None, None]
    whole = np.empty((n, s, s))
    whole[part[order]] = through
    for k in range(1, int(number.max()) + 1):
        now = np.flatnonzero(number == k)
        a = np.einsum("ni,nij->nj", before[now - 1], whole[now - 1]) @ model.moves
        before[now] = a / a.sum(1, keepdims=True)
    for k in range(int(number.max()), 0, -1):
        now = np.flatnonzero(number == k)
        b = np.einsum("nij,nj->ni", whole[now], after[now]) @ model.moves.T
        after[now - 1] = b / b.sum(1, keepdims=True)
    return before, after


def expected_counts(model: Model, classes: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Baum-Welch counts of the whole sequences: starts, moves and emissions, flattened, and the log10 likelihood last."""
    s, kinds = model.emits.shape
    cuts, number = _cut(offsets, piece)
    before, after = _carried(model, classes, cuts, number)
    by_step, first, alive, order = _time_major(classes, cuts)
    emitted = np.ascontiguousarray(model.emits.T)[by_step]
    alpha = np.empty_like(emitted)
    scales = np.empty(len(by_step))
    for t in range(len(alive)):
        here = slice(first[t], first[t + 1])
        if t == 0:
            a = before[order[: alive[0]]] * emitted[here]
        else:
            a = (alpha[first[t - 1] : first[t - 1] + alive[t]] @ model.moves) * emitted[here]
        c = a.sum(1)
        scales[here] = c
        alpha[here] = a / c[:, None]
    # backward vectors at the pieces' ends, so scaled that each step's state probabilities sum to one
    last = alpha[first[np.diff(cuts)[order] - 1] + np.arange(len(order))] if len(by_step) else np.zeros((0, s))
    closing = after[order] / (last * after[order]).sum(1, keepdims=True)
    gamma = alpha  # becomes alpha * beta, last step first
    moved = np.zeros((s, s))
    onward = np.zeros((0, s))
    for t in range(len(alive) - 1, -1, -1):
        here = slice(first[t], first[t + 1])
        beta = closing[: alive[t]].copy()
        if len(onward):
            moved += alpha[first[t] : first[t] + len(onward)].T @ onward
            beta[: len(onward)] = onward @ model.moves.T
        onward = emitted[here] * beta / scales[here][:, None]
        gamma[here] = alpha[here] * beta
    # moves from a piece's last token to the next one's first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    later = np.flatnonzero(number > 0)
    moved += last[place[later - 1]].T @ onward[place[later]]
    emits = np.stack([np.bincount(by_step, gamma[:, k], kinds) for k in range(s)])
    starts = gamma[place[number == 0]].sum(0) if len(by_step) else np.zeros(s)
    return np.concatenate([starts, (moved * model.moves).ravel(), emits.ravel(), [np.log10(scales).sum()]])


def _batched(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[tuple[pa.RecordBatch, int]], np.ndarray, np.ndarray]]:
    """Rows of one or more batches, taken together up to BATCH tokens, with their class sequences."""
    rows: list[tuple[pa.RecordBatch, int]] = []
    found: list[np.ndarray] = []
    size = 0
    for b in batches:
        for k, x in enumerate(b.column(column)):
            c = np.frombuffer(x.as_py(), np.uint16)
            if rows and size + len(c) > BATCH:
                yield rows, np.concatenate(found), np.cumsum([0, *map(len, found)])
                rows, found, size = [], [], 0
            rows.append((b, k))
            found.append(c)
            size += len(c)
    if rows:
        yield rows, np.concatenate(found), np.cumsum([0, *map(len, found)])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of each token hash in the documents' texts."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n)], names=["word", "c"])

        for b in batches:
            for _, tokens, _ in tokens_of(b.column(0)):
                held.append(tokens)
                size += len(tokens)
                if size > 2_000_000:  # one row a word and so many tokens goes into the shuffle
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(counts, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _class_column(word: str) -> Column:
    own = F.shiftrightunsigned(word, 40).bitwiseAND(F.lit(SHARED - 1).cast("long")).cast("int")
    return F.when(F.col(word) == int(END.astype(np.int64)), F.lit(END_CLASS)).otherwise(own)


@dataclass(frozen=True)
class Counts:
    """What the tasks get of the training counts; all of bounded size."""

    tokens: int  # N
    types: int  # V
    class_mass: np.ndarray  # sum of c + 0.5 over the class's words, and 0.5 more for the unseen ones of a shared class
    head_words: np.ndarray  # sorted
    head_logs: np.ndarray  # log10(c + 0.5)
    own_words: np.ndarray  # sorted


def gather(counts: DataFrame) -> Counts:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    mass = np.full(SHARED + 1, 0.5)
    for r in counts.groupBy(_class_column("word").alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect():  # SHARED + 1 rows
        mass[r.k] = r.m + (0.5 if r.k < SHARED else 0.0)
    head = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    words, times = head.column("word").to_numpy().astype(np.int64).view(np.uint64), head.column("c").to_numpy()
    frequent = (np.arange(len(words)) < OWN) & (times >= OWN_COUNT) & (words != END)
    own, mine = words[frequent], times[frequent] + 0.5
    np.subtract.at(mass, ((own >> np.uint64(40)) & np.uint64(SHARED - 1)).astype(np.int64), mine)
    mass[:SHARED] = np.maximum(mass[:SHARED], 0.5)  # where only the unseen are left, up to rounding
    order, own_order = np.argsort(words), np.argsort(own)
    return Counts(int(n), int(v), np.concatenate([mass, mine[own_order]]), words[order], np.log10(times[order] + 0.5), own[own_order])


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, mass_log double, classes binary, rare binary, times binary"


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """Each document's class sequence, its sums over frequent words, and its rare words with their numbers."""
    logs_of_mass = np.log10(counts.class_mass)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, tokens, offsets in tokens_of(b.column(2)):
                n = len(offsets) - 1
                doc = np.repeat(np.arange(n), np.diff(offsets))
                place = np.minimum(np.searchsorted(counts.head_words, tokens), max(0, len(counts.head_words) - 1))
                frequent = counts.head_words[place] == tokens if len(counts.head_words) else np.zeros(len(tokens), bool)
                logs = np.where(frequent, counts.head_logs[place], 0.0) if len(counts.head_words) else np.zeros(len(tokens))
                kinds = classes_of(tokens, counts.own_words)
                # rare words, once a document
                d, w = doc[~frequent], tokens[~frequent]
                order = np.lexsort((w, d))
                d, w = d[order], w[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
                firsts = np.flatnonzero(new)
                times = np.diff(np.append(firsts, len(d))).astype(np.int32)
                rare, cut = signed(w[firsts]), np.searchsorted(d[firsts], np.arange(n + 1))
                cell = lambda x, o, i: x[o[i] : o[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, n),
                        b.column(1).slice(at, n),
                        pa.array(np.diff(offsets)),
                        pa.array(np.bincount(doc, frequent, n).astype(np.int64)),
                        pa.array(np.bincount(doc, logs, n)),
                        pa.array(np.bincount(doc, logs_of_mass[kinds], n)),
                        pa.array([cell(kinds, offsets, i) for i in range(n)], pa.binary()),
                        pa.array([cell(rare, cut, i) for i in range(n)], pa.binary()),
                        pa.array([cell(times, cut, i) for i in range(n)], pa.binary()),
                    ],
                    names=[x.split()[0] for x in ENCODED.split(", ")],
                )

    return docs.mapInArrow(encoded, ENCODED)


def _settled(rows: DataFrame, model: Model, share: np.ndarray) -> tuple[Model, list[float]]:
    """Baum-Welch over written rows (classes) from a model on, until ENOUGH; the log10 likelihoods before each round.

    Each round that goes on multiplies the log-likelihood by 1 - ENOUGH at
    least, so rounds end; on the test tables they are 3 to 8.
    """
    likelihood: list[float] = []
    while len(likelihood) < 2 or likelihood[-1] - likelihood[-2] > ENOUGH * -likelihood[-2]:

        def partial(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = None
            for _, classes, offsets in _batched(batches, 0):
                c = expected_counts(model, classes, offsets)
                total = c if total is None else total + c
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "v"])

        sums = rows.mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        if not sums.num_rows:
            return model, likelihood
        flat = np.zeros(STATES + STATES * STATES + STATES * len(share) + 1)
        flat[sums.column("k").to_numpy()] = sums.column("v").to_numpy()  # one row a cell of the bounded tables
        likelihood.append(float(flat[-1]))
        model = Model.from_counts(flat[:-1], share)
    return model, likelihood


def train(encoded: DataFrame, counts: Counts, workspace: Workspace) -> tuple[Model, list[float]]:
    """The model after Baum-Welch over all training rows, and the log10 likelihood before each of its rounds.

    A part of the rows settles first, for a start near the end; then all rows do.
    """
    share = counts.class_mass / counts.class_mass.sum()
    rows = encoded.filter("not held_out")
    part = workspace.keep(rows.filter(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(WARM)) == 0).select("classes"), "warm")
    start, _ = _settled(part, Model.initial(share), share)
    workspace.drop("warm")
    return _settled(rows.select("classes"), start, share)


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, mass_log double, path_log double"


def score(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose crc32 of doc_id, written in decimal, leaves a
    remainder other than 1 by 5; all rows are scored, whole. Scores are log10
    probabilities of the tokens with their end. Defined results: a null or empty
    text is its end alone; a null doc_id counts as an empty string and so trains;
    repeated rows train and are scored each; an empty table gives no rows; with
    no training row all tokens are unknown. A very long text is one sequence, in
    training as in scoring. Other columns are not read. Two different words share
    a hash with a probability of about 2**-64.
    """
    ws = workspace or Workspace(docs.sparkSession, "hmm")
    doc_id = docs["doc_id"].cast("long")
    held = (F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1).alias("held_out")
    rows = docs.select(doc_id.alias("doc_id"), held, docs["text"].cast("string").alias("text"))
    words = ws.keep(count_words(rows.filter("not held_out")), "counts")
    counts = gather(words)
    encoded = ws.keep(encode(rows, counts).withColumn("rid", F.monotonically_increasing_id()), "encoded")
    model, _ = train(encoded, counts, ws)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for taken, classes, offsets in _batched(batches, 7):
            path = log_likelihood(model, classes, offsets)
            parts, at = [], 0
            while at < len(taken):  # rows of one batch are neighbours
                b, k = taken[at]
                to = at
                while to < len(taken) and taken[to][0] is b:
                    to += 1
                parts.append(pa.RecordBatch.from_arrays([*[b.column(c).slice(k, to - at) for c in range(7)], pa.array(path[at:to])], names=[x.split()[0] for x in SCORED.split(", ")]))
                at = to
            yield from parts

    paths = encoded.select("rid", "doc_id", "held_out", "n_tokens", "n_head", "head_log", "mass_log", "classes").mapInArrow(scored, SCORED)

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind) for c, kind in ((1, np.int64), (2, np.int32)))
            n = np.array([len(x) // 8 for x in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(w), pa.array(t)], names=["rid", "word", "times"])

    rare = encoded.select("rid", "rare", "times").mapInArrow(rare_words, "rid long, word long, times int")
    known = F.coalesce("c", F.lit(0))
    rare = join_unique(ws.keep(rare, "rare"), words, ["word"], "left").groupBy("rid").agg(F.sum(F.col("times") * F.log10(known + 0.5)).alias("rare_log"), F.sum(F.when(known > 0, F.col("times")).otherwise(0)).alias("n_rare"))
    total_log = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    return paths.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (total_log - F.col("n_tokens") * F.lit(float(np.log10(counts.tokens + 0.5 * (counts.types + 1))))).alias("base_score"),
        (F.col("path_log") + total_log - F.col("mass_log")).alias("score"),
    )
