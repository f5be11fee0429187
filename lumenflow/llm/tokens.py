"""Whole-text encoding with the tokenizers library, a piece of text at a time, each distinct piece once.

A byte-pair tokenizer never merges across its pre-tokens, so a text's ids are those of its pieces in order when
pieces are cut only where a pre-token must end. Pieces repeat a great deal; a bounded cache keeps their ids.
Pre-tokens of plain printable Latin texts go straight to the library's model, pieces of all others through its whole pipeline.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from lumenflow.llm.common import Recent, worker_cache

# The public tokenizers' pre-token patterns, for texts of the first line's characters alone, where
# Python's own, faster expressions agree with the library's.
_PLAIN = re.compile("[\n -~À-ÖØ-öø-ÿ]*")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_PLAIN_BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_CONTROL = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Words, and other pieces, that a generation of a worker's cache holds: about 150 MB in all.
WORDS, OTHERS = 450_000, 50_000


class PieceCache(Recent):
    """Word of a plain text -> ids as little-endian bytes (byte level: as it follows a space); literals of added tokens get these tokens' ids, as in the library.

    A pre-token that could be a word is kept as that word, so words with punctuation beside them find it.
    """

    def __init__(self, path: str, words: int = WORDS):
        super().__init__(self._word, words)
        self.tok = Tokenizer.from_file(path)
        literals = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, literals)), re.IGNORECASE) if literals else None
        self.lower, self.letters, self.model = self.tok.normalizer is not None, _byte_letters(), self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.inner, self.other = Recent(self._ids, OTHERS, 100), Recent(self._whole, OTHERS, 100)

    def _ids(self, pretoken: str) -> bytes:
        mapped = pretoken.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _pretoken(self, p: str) -> bytes:
        if not self.lower and (p[0] != " " or len(p) == 1):
            return self.inner[p]
        key = p if self.lower else p[1:]
        found = self.get(key) or self.older.get(key)
        return self.keep(key, self._ids(p)) if found is None else found

    def _plain(self, text: str) -> bytes:
        found = _PLAIN_WORD.findall(text.lower()) if self.lower else _PLAIN_BYTE.findall(text)
        return b"".join(map(self._pretoken, found))

    def _word(self, word: str) -> bytes:
        return self._plain(word if self.lower else " " + word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as bytes of self.dtype; a null text is empty."""
        if not text:
            return b""
        if self.added and self.added.search(text):
            return self._whole(text)
        if _PLAIN.fullmatch(text):
            if self.lower:
                return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
            if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
                return self._plain(text)
            first, *rest = text.split(" ")
            return self._plain(first) + b"".join(map(self.__getitem__, rest))
        if _CONTROL.search(text):  # Python and the library differ on whether these are white space
            return self._whole(text)
        pieces = text.replace("\n", " ").split(" ") if self.lower else _PIECES.findall(text)
        return b"".join([self.other[p] for p in pieces if p])


def cache_for(path: str) -> PieceCache:
    """The cache of a tokenizer file, the only one that a Python worker holds."""
    return worker_cache(f"tokens-{path}", lambda: PieceCache(path))
