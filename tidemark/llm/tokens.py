"""Token ids of whole texts, with the ids of a white-space separated chunk kept between texts."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

#: Chunks, and word pieces, whose ids a Python worker keeps (about 200 bytes each); two generations of this size at most.
KEPT, KEPT_PIECES = 400_000, 200_000
#: Chunks of these characters: neither white space nor combining, and one character each in lower case.
SIMPLE = re.compile("[!-~\\u00a1-\\u012f]*")
#: Signs that a word often ends with; none begins a contraction.
STOPS = frozenset(".,;:!?)")
#: How this vocabulary's tokenizer splits lower-cased text, and how it writes bytes as characters.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_names() -> dict[int, str]:
    """Byte-level alphabets name printable Latin-1 bytes by themselves and the others by U+0100 onwards, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept(dict):
    """key -> value by ``make``; when full, the older generation goes."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class ChunkTokenizer:
    """The ids that a word-level tokenizer gives, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks one after
    another. A chunk of simple characters is split and merged by the tokenizer's own model; any other chunk, or one with
    a special token's string, goes through the whole tokenizer.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain  # then special tokens' strings are ordinary text
        self.model, self.names = self.whole.model, byte_names()
        self.pieces, self.chunks = Kept(self._piece, KEPT_PIECES), Kept(self._chunk)

    def _piece(self, word: str) -> bytes:
        named = word if word.isascii() else "".join(self.names[b] for b in word.encode())
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():  # a word, perhaps with a sign behind it: most chunks
            if chunk.isalpha():
                return self.pieces[chunk.lower()]
            if chunk[-1:] in STOPS and chunk[:-1].isalpha():
                return self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        if "<|" in chunk or not SIMPLE.fullmatch(chunk):
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.pieces[w] for w in WORDS.findall(chunk.lower())])

    def forget(self) -> None:
        """Drop what was kept: at the end of a task, since the worker goes on to other work."""
        for kept in (self.pieces, self.chunks):
            kept.clear()
            kept.old = {}

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


_made: dict[tuple[str, bool], ChunkTokenizer] = {}


def tokenizer(path: str, plain: bool = False) -> ChunkTokenizer:
    """One for each Python worker and file."""
    if (path, plain) not in _made:
        _made.clear()
        _made[path, plain] = ChunkTokenizer(path, plain)
    return _made[path, plain]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
