"""Alignment of two tokenizers over a corpus, and corpus-wide counts of linked token pairs.

A first pass gathers the distinct pairs of each task. They are numbered by a
minimal perfect hash, built apart in slices; each task's counts become dense
vectors indexed by it, which are summed in a tree. A second pass aligns the
documents again and looks the counts up, with every key verified.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.bpe import byte_alphabet
from redactory.llm.common import in_worker, materialise, parts_of, per_batch
from redactory.llm.lexicon import frequent

#: Numbers of B ids in a pair's key: key = a * SIDE + b, below 2^31 for vocabularies of up to 65,000 and 32,000.
SIDE = 32_768
#: Most pairs of the hash that is sent to all tasks (about 14 bytes each); rarer pairs beyond it are joined.
MOST_PAIRS = 4_000_000
#: Keys of a slice of the hash, counters of a segment of the vectors, and words that a worker keeps.
SLICE_KEYS, SEGMENT, KEPT_WORDS = 16_384, 32_768, 800_000
#: Characters that are aligned at once, and pairs that a task holds before it sums them up, or hands them on.
PORTION, HELD_PAIRS = 1 << 20, 2_000_000
#: New words whose tokens are made at once.
AT_ONCE = 4096
_INNER = re.compile(r"(?<=\S)(?=(?: |\n+)\S)")
#: Words that may follow one another in a text without a change of their tokens.
_PLAIN = re.compile(r"(?: |\n+)[^\s▁](?:[^▁]*[^\s▁])?")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class Aligned(NamedTuple):
    """Several texts, one after the other: their tokens, links and groups."""

    a: np.ndarray  # ids
    b: np.ndarray
    links: np.ndarray  # keys of all overlapping pairs of tokens, in order
    a_group: np.ndarray  # each token's group
    b_group: np.ndarray
    n_groups: int
    sizes: np.ndarray  # a row for each text: tokens of A and of B, groups, links


class Words(dict):
    """word -> its number; words not met yet get the next one and are noted."""

    def __init__(self, *own):
        super().__init__(*own)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Aligner:
    """Tokens of texts on both sides and their alignment; ids are kept by word in each worker.

    Neither tokenizer lets a token go on from a sign into a single space or a run
    of line ends before another sign: a space only begins pieces in both
    vocabularies (checked for B, true of A's splitter), and no piece of B holds a
    line end. So a text's tokens are those of its words in a row, each with what
    parts it from the word before.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = {c: bytes([i]) for i, c in enumerate(byte_alphabet())}
        tokens = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.a_bytes[i] = b"".join(map(alphabet.__getitem__, t)) if all(c in alphabet for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes.fromhex(m[1]) if (m := _BYTE.match(p)) else p.replace("▁", " ").encode() for p in pieces]
        if not {bytes([i]) for i in range(256)} <= set(self.a_bytes):
            raise ValueError("the first vocabulary lacks a byte")
        if len(pieces) > SIDE or any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("the second vocabulary has too many pieces, or pieces that go on across a space")
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.forget(0)

    def forget(self, keep: int) -> None:
        """Keep only the words that were learned first."""
        if keep:
            self.words = Words(dict(islice(self.words.items(), keep)))
            self.ids = [x[: sum(n[:keep])] for x, n in zip(self.ids, self.sizes)]
            self.sizes, self.unequal = [n[:keep] for n in self.sizes], self.unequal[:keep]
        else:
            self.words, self.ids, self.sizes, self.unequal = Words(), [array("I"), array("I")], [array("I"), array("I")], array("B")

    def split(self, text: str) -> list[str]:
        """The words of a space and the text; where other white space or runs of spaces come, they stay inside one."""
        text = " " + text
        if " ".join(text.split()) == text[1:].replace("\n", " "):
            return text.replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")[1:]
        return _INNER.split(text)

    def learn(self) -> None:
        """Tokens of the new words: many in a row as one text, whose tokens are parted at the words' ends."""
        new, self.words.new = self.words.new, []
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            if not (all(map(_PLAIN.fullmatch, some)) and self.learn_row(some)):
                for w in some:
                    if not (_PLAIN.fullmatch(w) and self.learn_row([w])):
                        self.learn_one(w)

    def keep(self, a: Iterable[int], b: Iterable[int], n_a: Iterable[int], n_b: Iterable[int], unequal: Iterable[bool]) -> None:
        for ids, sizes, own, n in zip(self.ids, self.sizes, (a, b), (n_a, n_b)):
            ids.extend(own)
            sizes.extend(n)
        self.unequal.extend(unequal)

    def learn_row(self, words: list[str]) -> bool:
        """Tokens of words that both sides give back, from one text; False if some word is not given back."""
        text = "".join(words)
        raw = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:] if text[0] == " " else text)
        if text[0] != " ":
            b = b[1:] if b[:1] == [self.space] else []
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return False
        ends = np.cumsum([len(w.encode()) for w in words])
        sizes = []
        for ids, width in ((a, self.a_size), (b, self.b_size)):
            upto = np.cumsum(width[ids])
            at = np.searchsorted(upto, ends)
            if at[-1] >= len(upto) or (upto[at] != ends).any():
                return False
            sizes.append(np.diff(at + 1, prepend=0).tolist())
        self.keep(a, b, *sizes, bytes(len(words)))
        return True

    def learn_one(self, w: str) -> None:
        b = self.b.encode(w[1:] if w[0] == " " else w)
        if w[0] != " ":
            if b[:1] != [self.space]:
                raise ValueError("a piece of the second vocabulary goes on across a line end")
            del b[0]
        a = self.a.encode(w, add_special_tokens=False).ids
        self.keep(a, b, [len(a)], [len(b)], [b"".join(map(self.b_bytes.__getitem__, b)) != w.encode()])

    def align(self, texts: list[str | None]) -> Aligned:
        """All texts at once: each stretch between neighbouring ends of either side is one link."""
        if len(self.words) > KEPT_WORDS:
            self.forget(KEPT_WORDS // 4)
        split = [self.split(t) if t else [] for t in texts]
        counts = np.array(list(map(len, split)), np.int64)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.learn()
        texts_of = np.repeat(np.arange(len(texts)), counts)
        bad = np.bincount(texts_of, np.array(self.unequal, bool)[at] if len(at) else None, len(texts)) > 0
        at, counts = at[~bad[texts_of]], np.where(bad, 0, counts)
        stops, sides = np.cumsum(counts), []
        for ids, sizes, width in zip(self.ids, self.sizes, (self.a_size, self.b_size)):
            sizes = np.array(sizes, np.int64)
            own = sizes[at]
            upto = np.append(0, np.cumsum(own))
            begin = (np.cumsum(sizes) - sizes)[at] - upto[:-1]
            own_ids = np.array(ids, np.int64)[np.repeat(begin, own) + np.arange(upto[-1])] if len(at) else np.zeros(0, np.int64)
            sides.append((own_ids, np.cumsum(width[own_ids]), np.diff(upto[stops], prepend=0)))
        (a, a_end, n_a), (b, b_end, n_b) = sides
        size = int(a_end[-1]) + 1 if len(a_end) else 1
        a_here, b_here = np.zeros(size, bool), np.zeros(size, bool)  # whether a token ends at a byte
        a_here[a_end], b_here[b_end] = True, True
        both = a_here & b_here
        ends = np.flatnonzero(a_here | b_here)
        links = a[np.cumsum(a_here, dtype=np.int32)[ends - 1]] * SIDE + b[np.cumsum(b_here, dtype=np.int32)[ends - 1]]
        groups_upto = np.cumsum(both, dtype=np.int32)
        text_end = np.concatenate([[0], a_end])[np.cumsum(n_a)]
        counts = [np.diff(x[text_end], prepend=0) for x in (groups_upto, np.cumsum(a_here | b_here, dtype=np.int32))]
        return Aligned(a, b, links, groups_upto[a_end - 1], groups_upto[b_end - 1], int(groups_upto[-1]), np.stack([n_a, n_b, *counts], 1).astype(np.int64))

    def groups(self, x: Aligned) -> list[str]:
        """Of each text: ids of A, a bar, ids of B in every group; empty without tokens."""
        if not hasattr(self, "signs"):
            self.signs = [np.array([f"{i}{sign}" for sign in signs for i in range(n)], object) for n, signs in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))]
        out = np.empty(len(x.a) + len(x.b), object)
        a_last, b_last = (np.append(g[1:] != g[:-1], [True] * (len(g) > 0)) for g in (x.a_group, x.b_group))
        a_upto, b_upto = (np.cumsum(np.bincount(g, minlength=x.n_groups)) for g in (x.a_group, x.b_group))
        out[np.arange(len(x.a)) + np.append(0, b_upto)[x.a_group]] = self.signs[0][x.a + len(self.a_bytes) * a_last]
        out[np.arange(len(x.b)) + a_upto[x.b_group]] = self.signs[1][x.b + len(self.b_bytes) * b_last]
        every, stops = out.tolist(), np.cumsum(x.sizes[:, 0] + x.sizes[:, 1]).tolist()
        return ["".join(every[i:j])[:-1] for i, j in zip([0, *stops], stops)]


def portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about PORTION characters or one text."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t or "") > PORTION:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t or "")
    if own:
        yield own


def aligner(a_path: str, b_path: str) -> Aligner:
    return in_worker(("align", a_path, b_path), lambda: Aligner(a_path, b_path))


def mixed(keys: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit mix of keys, different for each seed."""
    z = keys.astype(np.uint64) + (np.atleast_1d(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def buckets_of(n: int) -> int:
    """Buckets of a slice of n keys: two keys in each on average."""
    return max(1, n // 2)


def perfect_slice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys: each bucket's seed and size, and the keys in the order of their numbers.

    A bucket's seed is the first that sends its keys to different places among
    as many as it has keys, so the numbers leave no gap.
    """
    n_buckets = buckets_of(len(keys))
    bucket = (mixed(keys) % np.uint64(n_buckets)).astype(np.int64)
    sizes = np.bincount(bucket, minlength=n_buckets)
    base = np.cumsum(sizes) - sizes
    seeds, placed = np.zeros(n_buckets, np.uint32), np.empty(len(keys), np.int64)
    left, seed = np.arange(len(keys)), 0
    while len(left):
        own = bucket[left]
        slot = base[own] + (mixed(keys[left], seed + 1) % sizes[own].astype(np.uint64)).astype(np.int64)
        times = np.bincount(slot, minlength=len(keys))
        good = np.ones(n_buckets, bool)
        good[own[times[slot] > 1]] = False
        done = good[own]
        placed[slot[done]] = keys[left[done]]
        seeds[own[done]] = seed
        left, seed = left[~done], seed + 1
    return seeds, sizes.astype(np.uint8), placed


class PairHash:
    """Numbers of the keys, without gaps; -1 for a key that is not among them."""

    def __init__(self, slices: int, parts: dict[int, tuple[bytes, bytes, bytes]]):
        take = lambda i, kind: [np.frombuffer(parts[s][i], kind) if s in parts else np.zeros(0, kind) for s in range(slices)]
        seeds, sizes, keys = take(0, np.uint32), take(1, np.uint8), take(2, np.int32)
        self.slices = slices
        self.n_buckets = np.array([len(x) for x in seeds], np.int64)
        self.first = np.cumsum(self.n_buckets) - self.n_buckets
        self.seeds, self.sizes, self.keys = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (seeds, sizes, keys))

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not hasattr(self, "base"):  # made in each worker, not sent
            self.base = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        out = np.full(len(keys), -1, np.int64)
        at = keys % self.slices if self.slices else keys
        own = np.flatnonzero(self.n_buckets[at] > 0) if self.slices else np.zeros(0, np.int64)
        k, at = keys[own], at[own]
        bucket = self.first[at] + (mixed(k) % self.n_buckets[at].astype(np.uint64)).astype(np.int64)
        own, k, bucket = (x[self.sizes[bucket] > 0] for x in (own, k, bucket))
        place = self.base[bucket] + (mixed(k, self.seeds[bucket].astype(np.uint64) + np.uint64(1)) % self.sizes[bucket].astype(np.uint64)).astype(np.int64)
        out[own] = np.where(self.keys[place] == k, place, -1)
        return out


def perfect_hash(keys: DataFrame, n: int) -> PairHash:
    """A minimal perfect hash of the n distinct keys in column pair, built apart for each slice."""
    slices = n // SLICE_KEYS | 1 if n else 0  # odd: pairs differ in low bits too

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seeds, sizes, placed = perfect_slice(np.sort(frame["pair"].to_numpy()))
        return pd.DataFrame({"slice": [key[0]], "seeds": [seeds.tobytes()], "sizes": [sizes.tobytes()], "placed": [placed.astype(np.int32).tobytes()]})

    if not slices:
        return PairHash(0, {})
    made = keys.select((F.col("pair") % slices).cast("int").alias("slice"), "pair").groupBy("slice").applyInPandas(build, "slice int, seeds binary, sizes binary, placed binary")
    return PairHash(slices, {r.slice: (r.seeds, r.sizes, r.placed) for r in made.collect()})  # at most MOST_PAIRS keys


def dense_counts(tallies: DataFrame, pairs: PairHash, fan: int = 16) -> np.ndarray:
    """Counts by number: a dense vector from each task, in segments, summed in a tree."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pairs), np.int64)
        for batch in batches:
            at = pairs(np.asarray(batch.column("pair")))
            total += np.bincount(at[at >= 0], np.asarray(batch.column("n"))[at >= 0], len(pairs)).astype(np.int64)  # exact: below 2^53
        parts = [(i, total[i * SEGMENT : (i + 1) * SEGMENT]) for i in range(-(-len(total) // SEGMENT))]
        parts = [(i, v.tobytes()) for i, v in parts if v.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([v for _, v in parts], pa.binary())], ["segment", "counts"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": [key[0]], "counts": [np.sum([np.frombuffer(b, np.int64) for b in frame["counts"]], axis=0).tobytes()]})

    kind = "segment int, counts binary"
    level = tallies.select("pair", "n").mapInArrow(leaves, kind)
    level = level.groupBy("segment", (F.spark_partition_id() % fan).alias("branch")).applyInPandas(add, kind).groupBy("segment").applyInPandas(add, kind)
    found = np.zeros(len(pairs), np.int64)
    for r in level.collect():  # one dense vector, at most MOST_PAIRS counters
        own = np.frombuffer(r.counts, np.int64)
        found[r.segment * SEGMENT : r.segment * SEGMENT + len(own)] = own
    return found


def task_pairs(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): in how many texts of its task each pair is linked, one row a pair unless a task holds very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = aligner(a_path, b_path), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "n"])

        for batch in batches:
            for part in parts_of(batch):
                for some in portions(part.column("text").to_pylist()):
                    x = own.align(some)
                    by_text = np.unique(np.repeat(np.arange(len(some)), x.sizes[:, 3]) << 31 | x.links)
                    held.append(np.unique(by_text & (1 << 31) - 1, return_counts=True))
                    size += len(held[-1][0])
                    if size > HELD_PAIRS:
                        held, size = [added(held)], 0
                        if len(held[0][0]) > HELD_PAIRS:
                            yield from out()
                            held = []
        held = [added(held)] if held else []
        yield from out()

    return texts.select("text").mapInArrow(run, "pair long, n long")


def added(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several lists of distinct keys and their counts as one."""
    keys, at = np.unique(np.concatenate([k for k, _ in tallies]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in tallies]), len(keys)).astype(np.int64)


def align_documents(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A reads a space and the text, B the text. Rows whose text is null or empty, or
    whose tokens' bytes are not a space and the text on either side, have no
    tokens: zeros and an empty groups_sha256. A pair's count is the number of rows
    that hold it linked; rows that repeat count each. n_best counts the links whose
    pair is, ties included, its A id's most frequent. Null doc_ids stay; other
    columns are not read; an empty table gives no rows.

    At most most_pairs pairs go into the hash, the most frequent ones; should there
    be more, the links of the others, which are rare, are joined to their counts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tallies = materialise(task_pairs(texts, a_path, b_path), "align-pairs")
    keys = materialise(tallies.select("pair").distinct(), "align-keys")
    n = keys.count()
    rare = None
    whole = n <= most_pairs
    if not whole:
        every = materialise(tallies.groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
        keys = materialise(frequent(every, most_pairs).select("pair"), "align-head")
        n = keys.count()
        rare = every.join(keys, "pair", "left_anti")
    pairs = perfect_hash(keys, n)
    counts = dense_counts(tallies, pairs)
    best = np.zeros(1 << 17, np.int64)  # by A id
    np.maximum.at(best, pairs.keys // SIDE, counts)
    if not whole:
        for r in rare.groupBy(F.expr(f"pair div {SIDE}").cast("int").alias("a")).agg(F.max("n").alias("n")).collect():  # a row an A id
            best[r.a] = max(best[r.a], r.n)
    sent = spark.sparkContext.broadcast((pairs, counts, best))

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = aligner(a_path, b_path)
        pairs, counts, best = sent.value
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest"]
        kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))]

        def looked_up(texts: list[str | None]) -> Iterator[tuple]:
            x = own.align(texts)
            at = pairs(x.links)
            found = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(at), np.int64)
            top = (found == best[x.links // SIDE]) & (at >= 0)
            stops = np.cumsum(x.sizes[:, 3])
            sums = [np.diff(np.append(0, np.cumsum(v))[stops], prepend=0).tolist() for v in (top, found)]
            rests = [[{"pair": k, "times": n} for k, n in zip(*map(np.ndarray.tolist, np.unique(x.links[i:j][at[i:j] < 0], return_counts=True)))] for i, j in zip([0, *stops[:-1]], stops)] if not whole else [[]] * len(texts)
            hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in own.groups(x)]
            return zip(*x.sizes.T.tolist(), *sums, hashes, rests, strict=True)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [r for some in portions(batch.column("text").to_pylist()) for r in looked_up(some)]
            made = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], ["doc_id", *names])

        return step

    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<struct<pair:long,times:long>>"
    done = per_batch(texts.select("doc_id", "text"), start, kind)
    if whole:
        return done.drop("rest")
    done = materialise(done.withColumn("row", F.monotonically_increasing_id()), "align-rows")
    tops = spark.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "a int, top long")  # a row an A id
    more = done.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times").join(rare, "pair").join(F.broadcast(tops), F.expr(f"cast(pair div {SIDE} as int)") == F.col("a"))
    more = more.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return done.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + zero("more_best")).alias("n_best"), (F.col("count_sum") + zero("more_sum")).alias("count_sum"), "groups_sha256")
