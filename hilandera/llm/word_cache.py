"""A bounded memory of words' token ids, with a short way for words of plain letters."""

from __future__ import annotations

import re
from array import array

#: A word of Latin letters, and the marks behind it: two pieces that need neither the tokenizer's
#: normalizer nor its pre-tokenizer.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level pieces: itself if it prints, else one above 255."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordCache(dict):
    """word -> its ids as little-endian unsigned 32-bit integers.

    known: words that stay. Others are encoded when asked for and kept in two generations of
    `limit` words: what was not asked for again while the younger one filled up is forgotten.
    """

    def __init__(self, path: str, known: dict | None = None, limit: int = 150_000):
        super().__init__(known or {})
        self.tokenizer = load(path)
        self.model, self.known, self.old, self.limit = self.tokenizer.model, known or {}, {}, limit + len(known or {})

    def piece(self, letters: str) -> bytes:
        """Ids of one pre-tokenized piece."""
        return packed(t.id for t in self.model.tokenize(letters.encode().decode("latin-1").translate(_LETTERS)))

    def ids(self, word) -> bytes:
        raise NotImplementedError

    def __missing__(self, word) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
            self.update(self.known)
        out = self.old.get(word)
        if out is None:
            out = self.ids(word)
        self[word] = out
        return out
