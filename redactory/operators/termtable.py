"""Terms in small memory: a table of hashes that a whole batch of texts is looked up in at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Signs of words; all others part them.
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_WORD_BYTE = np.array([chr(i) in WORD for i in range(256)])
#: Words of a term that is looked up by its hash, and its signs at most.
WORDS, SIGNS = 4, 128
#: Terms that begin and end with a word's sign, of few words and ASCII signs; all others are left to the caller.
PLAIN = rf"^[a-z0-9_]+([^a-z0-9_\x80-\x{{10FFFF}}]+[a-z0-9_]+){{0,{WORDS - 1}}}$"
#: Slices hashed at once.
STEP = 1 << 14
# An odd factor of hashes modulo 2**64, and its inverse.
_BY = 0x9E3779B97F4A7C15
_BACK = pow(_BY, -1, 1 << 64)


def lowered(text: str) -> str:
    """Lower case, sign by sign, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each slice of the bytes, whatever its place; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), STEP):
        a, b = starts[i : i + STEP], stops[i : i + STEP]
        low, high = a[0], b.max()
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _powers(_BY, high - low)[:-1], out=sums[1:])
        out[i : i + STEP] = (sums[b - low] - sums[a - low]) * _powers(_BACK, high - low)[a - low]
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and where they end."""
    word = np.concatenate([[False], _WORD_BYTE[data], [False]])
    return np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1


def ordered(names: Iterable[str | None]) -> list[str | None]:
    """Names of dictionaries without repeats, null last."""
    return sorted(set(names), key=lambda n: (n is None, n or ""))


class Table:
    """Plain terms as sorted hashes beside their bytes: 24 bytes a term and its signs. others are the terms that do not fit.

    rows: term, in lower case, and dictionary. A hash only finds a term; its bytes are compared.
    """

    def __init__(self, rows: pa.Table):
        by_term = rows.group_by("term", use_threads=False).aggregate([("dictionary", "list")])
        terms = by_term.column("term").combine_chunks().cast(pa.large_string())
        self.names = ordered(rows.column("dictionary").to_pylist())
        number, sets = {n: i for i, n in enumerate(self.names)}, {}
        owners = np.array([sets.setdefault(tuple(sorted({number[d] for d in x})), len(sets)) for x in by_term.column("dictionary_list").to_pylist()], np.int32)
        sizes = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pc.match_substring_regex(terms, PLAIN).to_numpy(zero_copy_only=False) & (sizes <= SIGNS)
        data, starts = np.frombuffer("\n".join(terms.to_pylist()).encode(), np.uint8), np.cumsum(sizes + 1) - sizes - 1
        places = np.flatnonzero(plain)
        found = hashes(data, starts[places], (starts + sizes)[places])
        order = np.argsort(found, kind="stable")
        same = found[order][1:] == found[order][:-1]
        alone = np.ones(len(order), bool)  # two terms of one hash are both left out
        alone[1:] &= ~same
        alone[:-1] &= ~same
        kept = places[order[alone]]
        plain[:] = False
        plain[kept] = True
        self.hashes, self.sizes, self.owners = found[order[alone]], sizes[kept].astype(np.int32), owners[kept]
        self.data, self.at = data[ranges(starts[kept], sizes[kept])], np.cumsum(sizes[kept]) - sizes[kept]
        begun, _ = borders(data)
        self.words = sorted(set((np.searchsorted(begun, (starts + sizes)[kept]) - np.searchsorted(begun, starts[kept])).tolist()))
        # for each set of dictionaries its numbers, one after the other
        self.first = np.cumsum([0, *map(len, sets)])
        self.own = np.array([i for x in sets for i in x], np.int32)
        self.others = {t: [self.names[i] for i in list(sets)[o]] for t, o in zip(terms.take(pa.array(np.flatnonzero(~plain))).to_pylist(), owners[~plain].tolist(), strict=True)}

    def places(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of texts in lower case: arrays of the text's place, the number of the dictionary's name, start and stop, for each number of words."""
        if not len(self.hashes):
            return
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        begin = np.cumsum([0, *(len(x) + 1 for x in raw)])[:-1]
        starts, stops = borders(data)
        of = np.searchsorted(begin, starts, "right") - 1
        inner = None if len(data) == sum(map(len, texts)) + max(len(texts) - 1, 0) else np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
        for n in self.words:
            last = len(starts) - n + 1
            if last <= 0:
                continue
            a, b, text = starts[:last], stops[n - 1 :], of[:last]
            fit = np.flatnonzero((text == of[n - 1 :]) & (b - a <= SIGNS))
            if not len(fit):
                continue
            a, b, text = a[fit], b[fit], text[fit]
            mine = hashes(data, a, b)
            at = np.minimum(np.searchsorted(self.hashes, mine), len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == mine) & (self.sizes[at] == b - a))
            a, b, text, at = a[hit], b[hit], text[hit], at[hit]
            if len(hit):  # the bytes decide
                size = b - a
                equal = data[ranges(a, size)] == self.data[ranges(self.at[at], size)]
                sure = np.logical_and.reduceat(equal, np.cumsum(size) - size)
                a, b, text, at = a[sure], b[sure], text[sure], at[sure]
            owners = self.owners[at]
            times = self.first[owners + 1] - self.first[owners]
            names = self.own[ranges(self.first[owners], times)]
            a, b, text = (np.repeat(x, times) for x in (a, b, text))
            base = begin[text]
            if inner is None:
                yield text, names, a - base, b - base
            else:  # places in signs, not bytes
                yield text, names, a - base - (inner[a] - inner[base]), b - base - (inner[b] - inner[base])
