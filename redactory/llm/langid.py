"""Language identification by cross-parsing.

Each language has a suffix automaton of a bounded amount of labelled text. A word
is parsed against it: each phrase is the longest match from where the last one
ended. The language whose automaton needs the fewest phrases for the text's
letters, each weighed by the logarithm of the sample's length, wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.common import fold, in_worker, keep_where, per_batch

#: Bounds of what is learned from: documents of a language, letters of a document and of a language.
DOCS, DOC_CHARS, LANGUAGE_CHARS = 96, 20_000, 80_000
SHARPNESS = 25.0
#: Chunks kept in a worker before it starts anew; letters from which on a word is parsed alone; characters of texts whose new chunks are parsed together.
_CACHE, _LONG, GROUP_CHARS = 100_000, 64, 1 << 18
_LETTERS = regex.compile(r"\p{L}+")


class SuffixAutomaton:
    """All substrings of a text.

    keys holds each transition as state * width + the letter's code, in order, and to
    where it leads: some bytes a transition, where a dictionary a state takes hundreds.
    """

    def __init__(self, text: str):
        nexts, links, lens, last = [{}], [-1], [0], 0
        for c in text:
            new = len(nexts)
            nexts.append({})
            lens.append(lens[last] + 1)
            links.append(0)
            at, last = last, new
            while at >= 0 and c not in nexts[at]:
                nexts[at][c] = new
                at = links[at]
            if at >= 0:
                old = nexts[at][c]
                if lens[old] == lens[at] + 1:
                    links[new] = old
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[old]))
                    lens.append(lens[at] + 1)
                    links.append(links[old])
                    links[old] = links[new] = copy
                    while at >= 0 and nexts[at].get(c) == old:
                        nexts[at][c] = copy
                        at = links[at]
        codes = {c: i for i, c in enumerate(sorted(set(text)), 1)}
        self.width = len(codes) + 1
        kind = np.uint32 if len(nexts) * self.width < 1 << 32 else np.uint64
        edges = sum(map(len, nexts))
        keys = np.fromiter((at * self.width + codes[c] for at, row in enumerate(nexts) for c in row), kind, edges)
        to = np.fromiter((x for row in nexts for x in row.values()), kind, edges)
        order = keys.argsort()
        self.keys, self.to = np.append(keys[order], np.array(np.iinfo(kind).max, kind)), np.append(to[order], np.array(0, kind))
        #: A letter's code by its code point, and where it leads from the root; 0 is a letter not seen.
        self.code = np.zeros(max(map(ord, codes), default=0) + 2, kind)
        self.first = np.zeros(self.width, kind)
        for c, i in codes.items():
            self.code[ord(c)], self.first[i] = i, nexts[0][c]

    def phrases(self, word: str) -> int:
        """Greedy longest matches that cover the word; a letter not seen at all is a phrase of its own."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        codes = self.code[np.minimum(points, len(self.code) - 1)].tolist()
        first, width, known, state, n = self.first.tolist(), self.width, {}, 0, 1
        for c in codes:
            key = state * width + c
            to = known.get(key)
            if to is None:
                at = int(self.keys.searchsorted(self.keys.dtype.type(key)))
                known[key] = to = int(self.to[at]) if self.keys[at] == key else 0
            if not to:  # no transition leads to the root
                n += state > 0
                to = first[c]
                n += to == 0
            state = to
        return n

    def phrases_each(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """phrases of many words at once, letter by letter: code points of all, where each begins, and sizes from the longest to the shortest."""
        codes = self.code[np.minimum(points, len(self.code) - 1)]
        state, n = np.zeros(len(starts), self.keys.dtype), np.ones(len(starts), np.int64)
        width = self.keys.dtype.type(self.width)
        for p in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -p))  # words longer than p come first
            c, before = codes[starts[:live] + p], state[:live]
            key = before * width + c
            at = self.keys.searchsorted(key)
            missed = self.keys[at] != key
            to = np.where(missed, self.first[c], self.to[at])
            n[:live] += missed & (before > 0)
            n[:live] += missed & (to == 0)
            state[:live] = to
        return n


def parser(samples: tuple[str, ...]) -> Parser:
    """The parser of these samples, kept in the worker."""
    return in_worker(("language", samples), lambda: Parser(samples))


class Parser:
    """What is known of chunks: letters, and phrases per language."""

    def __init__(self, samples: tuple[str, ...]):
        self.automata = [SuffixAutomaton(s) for s in samples]
        self.known: dict[str, bytes] = {}

    def totals(self, chunks: list[str]) -> np.ndarray:
        """Letters, and phrases per language, of all these chunks together; each must be known."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.int32).reshape(-1, len(self.automata) + 1).sum(axis=0, dtype=np.int64)

    def learn(self, chunks: Iterable[str]) -> None:
        """Get to know the chunks that are new; what was known before may go."""
        if len(self.known) > _CACHE:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        words, owners = [], []
        for i, chunk in enumerate(new):
            found = [chunk] if chunk.isascii() and chunk.isalpha() else _LETTERS.findall(chunk)
            words += found
            owners += [i] * len(found)
        rows = np.zeros((len(new), len(self.automata) + 1), np.int64)
        if words:
            owner, size = np.array(owners), np.fromiter(map(len, words), np.int64, len(words))
            np.add.at(rows, (owner, 0), size)
            for i in np.flatnonzero(size > _LONG):
                rows[owner[i], 1:] += [a.phrases(f" {words[i]} ") for a in self.automata]
            short = np.flatnonzero(size <= _LONG)
            short = short[np.argsort(-size[short], kind="stable")]
            points = np.frombuffer(f" {' '.join([words[i] for i in short])} ".encode("utf-32-le"), np.uint32)
            ends = np.cumsum(size[short] + 1)  # a word's last space is the first of the next
            for k, a in enumerate(self.automata, 1):
                np.add.at(rows, (owner[short], k), a.phrases_each(points, ends - size[short] - 1, size[short] + 2))
        self.known.update(zip(new, (r.tobytes() for r in rows.astype(np.int32)), strict=True))


def _slice(text: Column, doc_id: Column) -> Column:
    """A short text as it is; of a longer one DOC_CHARS letters and spaces of its words, from a place that doc_id's hash gives."""
    words = F.trim(F.regexp_replace(text, r"[^\p{L}]+", " "))
    at = F.pmod(F.xxhash64(doc_id, F.lit("slice")), F.greatest(F.length(words) - DOC_CHARS + 1, F.lit(1)))
    return F.when(F.length(text) <= DOC_CHARS, text).otherwise(F.substr(words, (at + 1).cast("int"), F.lit(DOC_CHARS)))


def learn(docs: DataFrame) -> dict[str, str]:
    """A bounded sample of each language's letters: words in lower case, joined by spaces.

    Every language that has a labelled text with a letter is learned; a text above
    DOC_CHARS gives a slice of its words.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where((fold(F.col("doc_id").cast("long"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    order = Window.partitionBy("lang").orderBy("share", "doc_id")
    few = own.join(F.broadcast(counts), "lang").withColumn("share", share).where(F.col("share") * F.col("n") < 4 * DOCS)  # about 4 * DOCS rows a language are ranked
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCS)
    rows = ranked.select("lang", "rank", _slice(F.col("text"), F.col("doc_id")).alias("text")).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        if len(out.get(r["lang"], "")) < LANGUAGE_CHARS and (words := _LETTERS.findall(r["text"].lower())):
            out[r["lang"]] = out.get(r["lang"], "") + f" {' '.join(words)} "
    return out


def _groups(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """Each text's chunks, in lists of texts of about GROUP_CHARS characters."""
    group, size = [], 0
    for text in texts:
        group.append((text or "").lower().split())
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    yield group


def _guesser(names: tuple[str, ...], samples: tuple[str, ...]):
    """Texts to (language, score)."""
    parse = parser(samples)
    #: A phrase of a longer sample is worth more bits; 1 for a sample of full length.
    size = np.log2([len(s) + 2 for s in samples]) / np.log2(LANGUAGE_CHARS)

    def guess(texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for group in _groups(texts):
            parse.learn(dict.fromkeys(chain.from_iterable(group)))
            for chunks in group:
                total = parse.totals(chunks)
                if not names or total[0] == 0:
                    out.append(("und", 0.0))
                    continue
                rate = total[1:] / total[0] * size
                best = int(rate.argmin())
                out.append((names[best], float(1 / np.exp(-SHARPNESS * (rate - rate[best])).sum())))
        return out

    return guess


def _model(docs: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    samples = learn(docs)
    return tuple(sorted(samples)), tuple(samples[n] for n in sorted(samples))


def identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its whole text.

    Null texts, and texts without a letter, are und with score 0; so is everything
    where nothing could be learned. Ties go to the language first in order. Score
    is the winner's share when each language weighs exp(-SHARPNESS * phrases per letter).
    Repeated rows get equal answers. An empty table gives no rows.
    """
    model = _model(docs)

    def setup():
        guess = _guesser(*model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = zip(*guess(batch.column("text").to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return step

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id").cast("long"), 4) == 2).alias("held_out"), "text")
    return per_batch(own, setup, "doc_id long, held_out boolean, lang_pred string, score double")


def reject_unknown(docs: DataFrame, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language of at least this score."""
    model = _model(docs)

    def setup():
        guess = _guesser(*model)
        return lambda texts: [lang != "und" and score >= least for lang, score in guess(texts)]

    return keep_where(docs, setup)
