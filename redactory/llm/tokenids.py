"""Token ids of whole texts by the tokenizers library, kept per white-space chunk in each worker."""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex

from redactory.llm.bpe import byte_alphabet
from redactory.llm.common import in_worker

#: Chunks kept in a worker before it starts anew.
CACHE_CHUNKS = 900_000
#: The pattern of the library's byte-level splitter (a fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs that part from the word before them.
_STOPS = frozenset(".,;:!?")
#: White space to Python, but not to the tokenizers' patterns.
_CUT = "\x1f"
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class IdCoder:
    """text -> ids as little-endian uint32 bytes, equal to Tokenizer.encode(text, add_special_tokens=False).

    Chunks are what single spaces (or, where the file drops white space, any
    white space) part: no piece of either kind of splitter spans two of them, and
    normalisation acts inside them. Texts for which that does not hold go to the
    library whole. At most about most chunks are kept.
    """

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.most = most
        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"]]
        self.drops_space = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"]
        self.keeps_space = not spec["normalizer"] and [x["type"] for x in splits] == ["ByteLevel"] and splits[0]["use_regex"] and not splits[0]["add_prefix_space"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"] if self.drops_space else BYTE_LEVEL_PATTERN)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        table, coder, model = dict(enumerate(byte_alphabet())), self, self.tokenizer.model

        def merged(piece: str) -> bytes:
            plain = piece.replace(" ", table[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(table)
            return array("I", [t.id for t in model.tokenize(plain)]).tobytes()

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                self[piece] = out = merged(piece)
                return out

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes | None:
                text = chunk.lower() if coder.drops_space else chunk
                word = text[1:] if text[0] == " " else text
                if not word or word[0].isspace() or word[-1].isspace():
                    out = None  # a run of white space, where the splitter looks beyond the chunk
                elif max(chunk) >= "\u0130":
                    out = coder.whole(chunk)
                elif word.isalpha():  # one run of letters is one piece
                    out = merged(text) if text == chunk else self[text]
                elif word[-1:] in _STOPS and word[:-1].isalpha():  # and a sign after it another
                    out = self[text[:-1]] + coder.pieces[text[-1]]
                elif "<|" in chunk and any(s in chunk for s in coder.specials):
                    out = coder.whole(chunk)
                else:
                    out = b"".join(map(coder.pieces.__getitem__, coder.pattern.findall(text)))
                self[chunk] = out
                return out

        self.pieces, self.chunks = Pieces(), Chunks()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if len(self.chunks) + len(self.pieces) > self.most:
            self.chunks.clear()
            self.pieces.clear()
        if self.drops_space and not any(c in text for c in _SEPARATORS):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        if self.keeps_space and text and _CUT not in text:
            chunks = text.replace(" ", _CUT + " ").split(_CUT)
            try:
                return b"".join(map(self.chunks.__getitem__, chunks if chunks[0] else chunks[1:]))
            except TypeError:  # a chunk without an answer of its own
                pass
        return self.whole(text)


def id_coder(path: str, most: int = CACHE_CHUNKS) -> IdCoder:
    return in_worker(("ids", path, most), lambda: IdCoder(path, most))
