"""Language-model scores from a hidden Markov model over words.

Frequent words are symbols of their own; every other word shows as a class, by its
ending, and its own share within the class is a smoothed count. So a text's
probability is that of its symbols, by the scaled forward recursion, times the
shares of its rarer words. Parameters come from Baum-Welch: each round gathers
expected counts of all training texts, one row a symbol from each task, summed by
Spark; nothing but the parameters, whose size is fixed, passes the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import fold, in_worker, materialise, parts_of, per_batch
from redactory.llm.lexicon import frequent, summed, tallied

#: Words that are symbols, words whose counts are sent to all tasks (both at most), and classes of the other words.
SYMBOL_WORDS, HEAD_WORDS, ENDINGS = 8192, 200_000, 64
STATES, ROUNDS = 12, 3
#: First parameters are made from about so many training texts, drawn by hash, of at most so many words, in so many rounds; the
#: rounds over all training texts start there.
SEED_TEXTS, SEED_WORDS, SEED_ROUNDS = 1500, 3000, 15
#: Texts worked on side by side, steps kept between them, and cells of one such table at most.
LANES, SPAN, CELLS = 1024, 512, 4_000_000
#: Weight of the symbols' plain shares in each state, in tokens.
PRIOR = 10.0


class Model(NamedTuple):
    first: np.ndarray  # states
    move: np.ndarray  # states x states
    show: np.ndarray  # symbols x states


class Gathered(NamedTuple):
    first: np.ndarray
    move: np.ndarray
    show: np.ndarray


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text between ASCII white space, lower-cased in A-Z only."""
    return text.lower().split()


def ending(word: bytes) -> int:
    """The class of a word that is no symbol, by its last two bytes."""
    return crc32(word[-2:]) % ENDINGS


def tables(texts: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts side by side, the longest first: their numbers, symbols by step and lane, and how many lanes each step has."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(texts[order[at]]))
        lanes = order[at : at + max(1, min(LANES, CELLS // longest))]
        at += len(lanes)
        grid = np.zeros((longest, len(lanes)), np.uint16)
        for j, i in enumerate(lanes):
            grid[: len(texts[i]), j] = texts[i]
        sizes = np.array([len(texts[i]) for i in lanes])
        yield lanes, grid, np.searchsorted(-sizes, -np.arange(longest), side="left")


def forward(m: Model, grid: np.ndarray, active: np.ndarray, lo: int, hi: int, alpha: np.ndarray, keep: np.ndarray | None = None, scales: np.ndarray | None = None) -> np.ndarray:
    """Steps lo to hi of the scaled recursion, in place in alpha; the logarithms of the scales, summed by lane."""
    total, ones = np.zeros(len(alpha)), np.ones(len(m.first), m.first.dtype)
    for t in range(lo, hi):
        n = active[t]
        seen = m.show[grid[t, :n]]
        seen *= alpha[:n] @ m.move if t else m.first
        scale = seen @ ones  # their sums; faster than sum() over short rows
        np.divide(seen, scale[:, None], out=alpha[:n])
        total[:n] += np.log(scale)
        if keep is not None:
            keep[t - lo, :n], scales[t - lo, :n] = alpha[:n], scale
    return total


def log10_likelihoods(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Of each sequence of symbols, exactly: summed over all paths of states."""
    out = np.zeros(len(texts))
    for lanes, grid, active in tables(texts):
        out[lanes] = forward(m, grid, active, 0, len(grid), np.zeros((len(lanes), len(m.first)))) / math.log(10)
    return out


def gather(m: Model, texts: list[np.ndarray], into: Gathered) -> None:
    """Add the expected counts of these sequences (forward-backward).

    Only each span's first messages are kept on the way forward; a span's own are
    made again on the way back, so memory does not follow a text's length. Messages
    are in single precision, their sums in double.
    """
    states = len(m.first)
    exact, m = m, Model(*(x.astype(np.float32) for x in m))
    for lanes, grid, active in tables([t for t in texts if len(t)]):
        steps, starts = len(grid), []
        alpha = np.zeros((len(lanes), states), np.float32)
        for lo in range(0, steps, SPAN):
            starts.append(alpha.copy())
            if lo + SPAN < steps:
                forward(m, grid, active, lo, lo + SPAN, alpha)
        moved = np.zeros((states, states))
        ahead = np.zeros((0, states), np.float32)  # what the next step says of this one
        for lo in range(0, steps, SPAN)[::-1]:
            hi = min(lo + SPAN, steps)
            wide = active[lo]
            keep, scales = np.empty((hi - lo, wide, states), np.float32), np.empty((hi - lo, wide), np.float32)
            forward(m, grid, active, lo, hi, starts.pop()[:wide], keep, scales)
            for t in range(hi - 1, lo - 1, -1):
                n, more = active[t], len(ahead)
                own = keep[t - lo]
                beta = np.ones((n, states), np.float32)
                if more:
                    moved += own[:more].T @ ahead
                    beta[:more] = ahead @ m.move.T
                ahead = m.show[grid[t, :n]]
                ahead *= beta
                ahead /= scales[t - lo, :n, None]
                own[:n] *= beta
            if lo == 0:
                into.first[:] += keep[0].sum(0, dtype=np.float64)
            real = np.arange(wide) < active[lo:hi, None]  # not beyond a text's end
            cells = grid[lo:hi, :wide][real].astype(np.intp)
            for s, weights in enumerate(np.ascontiguousarray(keep[real].T, np.float64)):
                into.show[:, s] += np.bincount(cells, weights, len(into.show))
        into.move[:] += moved * exact.move


def empty(states: int, symbols: int) -> Gathered:
    return Gathered(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def improved(g: Gathered, plain: np.ndarray) -> Model:
    """Parameters from expected counts; plain shares of the symbols keep every one possible in every state."""
    first, move = g.first + 0.1, g.move + 0.1
    show = g.show + PRIOR * plain[:, None]
    return Model(first / first.sum(), move / move.sum(1, keepdims=True), show / show.sum(0))


def seeded(texts: list[np.ndarray], plain: np.ndarray, states: int, rounds: int = SEED_ROUNDS) -> Model:
    """First parameters: plain shares, shaken by a fixed draw, then rounds over these texts."""
    rng = np.random.default_rng(12)
    shaken = plain[:, None] * rng.gamma(2.0, 0.5, (len(plain), states))
    m = improved(Gathered(np.ones(states), rng.gamma(2.0, 1.0, (states, states)) + 3 * np.eye(states), shaken * 1e6), plain)
    for _ in range(rounds if texts else 0):
        g = empty(states, len(plain))
        gather(m, texts, g)
        m = improved(g, plain)
    return m


def expected(coded: DataFrame, m: Model) -> Gathered:
    """Expected counts of all rows, summed over the tasks by symbol."""
    states, symbols = len(m.first), len(m.show)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = empty(states, symbols)
        for batch in batches:
            for part in parts_of(batch):
                gather(m, [np.frombuffer(b, np.uint16) for b in part.column("symbols").to_pylist()], g)
        rows = np.concatenate([g.show, g.move, g.first[None]])
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(rows[used, s]) for s in range(states))], ["k", *(f"s{s}" for s in range(states))])

    sums = coded.select("symbols").mapInArrow(run, "k int, " + ", ".join(f"s{s} double" for s in range(states))).groupBy("k").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states)))
    every = np.zeros((symbols + states + 1, states))
    for r in sums.collect():  # a row a symbol
        every[r[0]] = r[1:]
    return Gathered(every[-1], every[symbols:-1], every[:symbols])


class Counts(NamedTuple):
    """What is learned from the training tokens besides the model."""

    tokens: int  # N
    kinds: int  # V
    ends: int
    head: dict[bytes, int]  # counts of frequent words
    symbols: dict[bytes, int]
    in_class: tuple[tuple[int, int], ...]  # of the words that are no symbols: tokens, kinds

    @property
    def size(self) -> int:
        return len(self.symbols) + ENDINGS + 1

    def base(self, c: int) -> float:
        return math.log10((c + 1) / (self.tokens + self.kinds + 1))

    def share(self, word: bytes, c: int) -> float:
        tokens, kinds = self.in_class[ending(word)]
        return math.log10((c + 1) / (tokens + kinds + 1))


def learned_counts(rows: DataFrame, symbol_words: int, head_words: int) -> tuple[Counts, DataFrame]:
    """Counts over all training rows, and the whole table of words."""
    words = materialise(summed(tallied(rows, lambda: words_of)), "hmm-words")
    ends = rows.where("learn").count()
    total, kinds = words.agg(F.coalesce(F.sum("learned"), F.lit(0)), F.count_if(F.col("learned") > 0)).first()
    # the head goes by all rows, so that no word outside it is frequent anywhere
    head = [(bytes(r.word), r.n, r.learned) for r in frequent(words, head_words).collect()]
    symbols = {w: i for i, (w, _, _) in enumerate(sorted((x for x in head if x[2]), key=lambda x: (-x[2], x[0]))[:symbol_words])}
    known = {w: c for w, _, c in head}
    sums = {i: [0, 0] for i in range(ENDINGS)}
    by_class = words.where("learned > 0").groupBy((F.crc32(F.substring("word", -2, 2)) % ENDINGS).cast("int").alias("k")).agg(F.sum("learned"), F.count(F.lit(1)))
    for k, tokens, own in by_class.collect():  # ENDINGS rows
        sums[k] = [tokens, own]
    for w in symbols:
        sums[ending(w)][0] -= known[w]
        sums[ending(w)][1] -= 1
    return Counts(total + ends, kinds + (ends > 0), ends, known, symbols, tuple(map(tuple, sums.values()))), words


def coded(rows: DataFrame, counts: Counts) -> DataFrame:
    """Each text as symbols, with what the head says of it; words outside the head are left for a join."""
    classes = len(counts.symbols)
    last = counts.size - 1

    class Head(dict):
        """word -> its place in the columns below; -1 for a word without a count here."""

        def __init__(self):
            super().__init__(zip(counts.head, range(len(counts.head))))
            own = [counts.symbols.get(w, classes + ending(w)) for w in counts.head]
            self.symbol = np.array(own, np.uint16)
            self.base = np.array([counts.base(c) for c in counts.head.values()])
            self.share = np.array([counts.share(w, c) if k >= classes else 0.0 for (w, c), k in zip(counts.head.items(), own)])
            self.known = np.array([c > 0 for c in counts.head.values()], bool)

        def __missing__(self, word: bytes) -> int:
            return -1

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        head = in_worker(("hmm", counts.tokens, len(counts.head)), Head)
        end = counts.base(counts.ends)

        def one(text: bytes | None) -> tuple:
            words = words_of(text) if text else []
            at = np.fromiter(map(head.__getitem__, words), np.int32, len(words))
            known, tail = at[at >= 0], [words[i] for i in np.flatnonzero(at < 0).tolist()]
            symbols = np.empty(len(words) + 1, np.uint16)
            symbols[-1] = last
            symbols[:-1][at >= 0] = head.symbol[known]
            symbols[:-1][at < 0] = [classes + ending(w) for w in tail]
            return len(words) + 1, int(head.known[known].sum()) + (counts.ends > 0), head.base[known].sum() + end, head.share[known].sum(), symbols.tobytes(), Counter(tail)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            *made, tails = list(zip(*map(one, batch.column("text").to_pylist()), strict=True)) or [()] * 6
            stops = np.cumsum([0, *map(len, tails)]).astype(np.int32)
            tail = pa.StructArray.from_arrays([pa.array([w for t in tails for w in t], pa.binary()), pa.array([n for t in tails for n in t.values()], pa.int32())], ["word", "times"])
            columns = [pa.array(x, k) for x, k in zip(made, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("learn"), *columns, pa.ListArray.from_arrays(pa.array(stops), tail)], ["doc_id", "learn", "n_tokens", "n_known", "base", "share", "symbols", "tail"])

        return step

    return per_batch(rows, start, "doc_id long, learn boolean, n_tokens long, n_known long, base double, share double, symbols binary, tail array<struct<word:binary,times:int>>")


def trained(texts: DataFrame, counts: Counts, states: int, rounds: int) -> Model:
    """Baum-Welch over all rows with learn."""
    own = texts.where("learn")
    plain = np.ones(counts.size)
    for w, i in counts.symbols.items():
        plain[i] += counts.head[w]
    plain[len(counts.symbols) : -1] += [tokens for tokens, _ in counts.in_class]
    plain[-1] += counts.ends
    plain /= plain.sum()
    able = own.where(F.col("n_tokens").between(20, SEED_WORDS))
    place = F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 << 30))  # about SEED_TEXTS rows lie below the limit, so no task sends more than its share
    few = able.where(place < int((1 << 30) * min(1.0, SEED_TEXTS / max(1, able.count())))).select("symbols").collect()
    m = seeded([np.frombuffer(r.symbols, np.uint16) for r in few], plain, states)
    for _ in range(rounds):
        m = improved(expected(own, m), plain)
    return m


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, states: int = STATES, rounds: int = ROUNDS, symbol_words: int = SYMBOL_WORDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Words and one end are a text's tokens (null: an empty text, so the end alone).
    Training rows are those whose doc_id's fold is not the held-out one; a row
    without a doc_id trains. base_score is the smoothed unigram's log10
    probability, score the hidden Markov model's, both of the whole text. Rows that
    repeat are scored each and train each. Without training rows the parameters
    are the plain start. Other columns are not read; an empty table gives no rows.
    """
    held_out = F.coalesce(fold(F.col("doc_id").cast("long"), folds) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (~held_out).alias("learn"))
    counts, words = learned_counts(rows, symbol_words, head_words)
    texts = materialise(coded(rows, counts).withColumn("row", F.monotonically_increasing_id()), "hmm-texts")
    m = trained(texts, counts, states, rounds)

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = log10_likelihoods(m, [np.frombuffer(b, np.uint16) for b in batch.column("symbols").to_pylist()])
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "learn", "n_tokens", "n_known", "base", "share")), pa.array(found, pa.float64())], ["row", "doc_id", "learn", "n_tokens", "n_known", "base", "share", "path"])

        return step

    scored = per_batch(texts.select("row", "doc_id", "learn", "n_tokens", "n_known", "base", "share", "symbols"), start, "row long, doc_id long, learn boolean, n_tokens long, n_known long, base double, share double, path double")
    c = F.coalesce("learned", F.lit(0))
    room = F.element_at(F.array(*(F.lit(t + k + 1) for t, k in counts.in_class)), (F.crc32(F.substring("word", -2, 2)) % ENDINGS + 1).cast("int"))
    rare = texts.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times").join(words.select("word", "learned"), "word", "left")
    rest = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(counts.tokens + counts.kinds + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((c + 1) / room)).alias("rare_share"),
    )
    both = scored.join(rest, "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return both.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("path") + F.col("share") + zero("rare_share")).alias("score"),
    )
