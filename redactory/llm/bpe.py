"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that ends its encoding.
The automaton of all vocabulary strings gives the tokens that end at a place;
a pair test tells whether such a token may follow the one stored for the shorter
prefix; the stored tokens, followed backwards, are the encoding.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import in_worker, per_batch, texts_of

#: Chunks kept in a worker before it starts anew; a miss is only encoded again.
CACHE_CHUNKS = 500_000
#: White space to Python, but not to the tokenizer's patterns.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Signs that part from the word before them.
_STOPS = frozenset(".,;:!?")
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class VocabularyAutomaton:
    """Suffix automaton of the vocabulary's strings, grown along their trie.

    ends[s] are the tokens (id, length) whose whole string belongs to state s, longest first.
    """

    def __init__(self, strings: dict[int, tuple[int, ...]]):
        nexts: list[dict[int, int]] = [{}]
        links, lens = [-1], [0]

        def grow(last: int, symbol: int) -> int:
            if symbol in nexts[last]:
                old = nexts[last][symbol]
                return old if lens[old] == lens[last] + 1 else split(last, symbol, old)
            new = len(nexts)
            nexts.append({})
            lens.append(lens[last] + 1)
            links.append(0)
            at = last
            while at >= 0 and symbol not in nexts[at]:
                nexts[at][symbol] = new
                at = links[at]
            if at >= 0:
                old = nexts[at][symbol]
                links[new] = old if lens[old] == lens[at] + 1 else split(at, symbol, old)
            return new

        def split(at: int, symbol: int, old: int) -> int:
            copy = len(nexts)
            nexts.append(dict(nexts[old]))
            lens.append(lens[at] + 1)
            links.append(links[old])
            links[old] = copy
            while at >= 0 and nexts[at].get(symbol) == old:
                nexts[at][symbol] = copy
                at = links[at]
            return copy

        level = {(): 0}
        by_length: dict[int, set[tuple[int, ...]]] = {}
        for s in strings.values():
            for n in range(1, len(s) + 1):
                by_length.setdefault(n, set()).add(s[:n])
        states: dict[tuple[int, ...], int] = {}
        for n in sorted(by_length):
            level = {s: grow(level[s[:-1]], s[-1]) for s in sorted(by_length[n])}
            states.update(level)
        ends: list[list[tuple[int, int]]] = [[] for _ in nexts]
        for token, s in strings.items():
            at = 0
            for symbol in s:
                at = nexts[at][symbol]
            ends[at].append((token, len(s)))
        self.step = {at << 10 | symbol: to for at, row in enumerate(nexts) for symbol, to in row.items()}
        self.links, self.lens = links, lens
        #: All tokens that end where a state is reached, longest first: its own, then its link's.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(nexts)
        for at in sorted(range(1, len(nexts)), key=lens.__getitem__):
            self.ends[at] = (*sorted(ends[at], key=lambda e: -e[1]), *self.ends[links[at]])


class PrefixBpe:
    """Exact ids of words under a byte-level BPE with optional word ends."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        byte = {c: b for b, c in enumerate(self.alphabet)}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair[left, right] = r
            self.rank[whole], self.parts[whole] = r, (left, right)
        strings = {}
        for s, i in self.vocab.items():
            ends = bool(self.end) and s.endswith(self.end)
            units = [byte[c] for c in (s[: -len(self.end)] if ends else s)]
            if ends and units:
                units[-1] += 256
            if units and (len(units) == 1 or i in self.parts):
                strings[i] = tuple(units)
        own = set()
        for i in sorted(strings, key=lambda x: self.rank.get(x, -1)):  # drop strings that BPE itself cuts
            if i not in self.parts or (self.parts[i][0] in own and self.parts[i][1] in own and self.fits(*self.parts[i], self.rank[i])):
                own.add(i)
        self.automaton = VocabularyAutomaton({i: strings[i] for i in own})
        self.size = {i: len(strings[i]) for i in own}
        #: Pair tests made so far, by the left token's id shifted and the right one's.
        self.known: dict[int, bool] = {}

    def fits(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether BPE leaves the border between two tokens alone, for merges before rank until.

        Both tokens grow at the border in order of rank; the border goes if a
        merge across it comes before whichever of them grows next. Of equal
        ranks the one further left comes first.
        """
        spine_a, spine_b = [left], [right]
        while spine_a[-1] in self.parts:
            spine_a.append(self.parts[spine_a[-1]][1])
        while spine_b[-1] in self.parts:
            spine_b.append(self.parts[spine_b[-1]][0])
        while True:
            next_a = self.rank[spine_a[-2]] if len(spine_a) > 1 else until
            next_b = self.rank[spine_b[-2]] if len(spine_b) > 1 else until
            across = self.pair.get((spine_a[-1], spine_b[-1]), NEVER)
            if across < next_a and across <= next_b and across < until:
                return False
            if len(spine_a) == 1 and len(spine_b) == 1:
                return True
            (spine_a if len(spine_a) > 1 and (len(spine_b) == 1 or next_a <= next_b) else spine_b).pop()

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        units = list(word.encode("utf-8"))
        if self.end:
            units[-1] += 256
        step, ends, known = self.automaton.step, self.automaton.ends, self.known
        if len(known) > 1_000_000:
            known.clear()

        def tested(before: int, token: int) -> bool:
            known[before << 20 | token] = fit = self.fits(before, token)
            return fit

        last = [-1] * (len(units) + 1)
        state = long = at = 0
        for unit in units:
            at += 1
            while (to := step.get(state << 10 | unit)) is None and state:
                state = self.automaton.links[state]
                long = self.automaton.lens[state]
            if to is None:
                raise ValueError(f"no token for byte {unit % 256}")
            state = to
            long += 1
            for token, n in ends[state]:
                if n > long:
                    continue
                if n == at:
                    last[at] = token
                    break
                if (before := last[at - n]) >= 0 and (known[before << 20 | token] if before << 20 | token in known else tested(before, token)):
                    last[at] = token
                    break
        out = []
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]


class TextBpe:
    """Whole texts to ids and back, as the tokenizer file at path prescribes.

    The file's own normaliser and splitter are applied to each white-space chunk;
    both act within chunks only. The merging is PrefixBpe's.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = PrefixBpe(path)
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.plain = self._plain(json.loads(open(path, encoding="utf-8").read()))
        self.back = {c: b for b, c in enumerate(self.bpe.alphabet)}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")") if self.bpe.special else None
        encoder = self

        names = {i: str(i) for i in self.bpe.token}

        def said(ids: list[int]) -> tuple[str, str]:
            return " ".join([names[i] for i in ids]), " ".join([encoder.bpe.token[i] for i in ids])

        class Words(dict):
            def __missing__(self, word: str) -> tuple[str, str]:
                self[word] = out = said(encoder.bpe.word(word))
                return out

        class Chunks(dict):
            def __missing__(self, chunk: str) -> tuple[str, str]:
                if not encoder.plain or max(chunk) >= "\u0130" or "<|" in chunk:
                    out = said(encoder.chunk(chunk))
                else:  # in normal form but for its case; a run of letters, and one with a sign after it, need no pattern
                    low, words = chunk.lower(), encoder.words
                    if low.isalpha():
                        out = words[low]
                    else:
                        pieces = [low[:-1], low[-1]] if low[-1] in _STOPS and low[:-1].isalpha() else encoder.plain.findall(low)
                        both = [words[p] for p in pieces]
                        out = " ".join([x[0] for x in both]), " ".join([x[1] for x in both])
                self[chunk] = out
                return out

        self.chunks, self.words = Chunks(), Words()

    @staticmethod
    def _plain(spec: dict) -> regex.Pattern | None:
        """The file's pattern, if its steps are normal form, white space, lower case, then pieces that match the pattern."""
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and not splits[1]["use_regex"]:
            return regex.compile(splits[0]["pattern"]["Regex"])
        return None

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a text, special tokens in it included."""
        ids: list[int] = []
        for part in self.specials.split(chunk) if self.specials and "<|" in chunk else [chunk]:
            if part in self.bpe.special:
                ids.append(self.bpe.special[part])
            elif part:
                for piece, _ in self.split.pre_tokenize_str(self.normalise.normalize_str(part) if self.normalise else part):
                    ids += self.bpe.word(bytes(map(self.back.__getitem__, piece)).decode("utf-8"))
        return ids

    def encode(self, text: str) -> tuple[str, str]:
        """The ids in decimal, joined by one space, and the tokens joined likewise (the file has no decoder)."""
        for known in (self.chunks, self.words):
            if len(known) > CACHE_CHUNKS:
                known.clear()
        if any(c in text for c in _SEPARATORS):
            ids = self.chunk(text)
            return " ".join(map(str, ids)), self.decode(ids)
        got = [c for c in map(self.chunks.__getitem__, text.split()) if c[0]]
        return " ".join([c[0] for c in got]), " ".join([c[1] for c in got])

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens, joined by a space; unknown ids are left out."""
        return " ".join(self.bpe.token[i] for i in ids if i in self.bpe.token)


def text_bpe(path: str) -> TextBpe:
    return in_worker(("bpe", path), lambda: TextBpe(path))


def encode_documents(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Encode and decode the whole text of every row.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep also
    ids (array of int) and decoded. Null text counts as empty and gives no
    tokens; repeated rows give repeated rows; no row depends on another.
    """

    def setup():
        coder = text_bpe(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, out_sha, kept = [], [], [], []
            for text in texts_of(batch):
                ids, decoded = coder.encode(text)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                out_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep:
                    kept.append(([int(i) for i in ids.split()], decoded))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([k[0] for k in kept], pa.list_(pa.int32())), pa.array([k[1] for k in kept], pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), setup, schema)
