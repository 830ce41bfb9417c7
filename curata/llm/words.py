"""Token ids of whole texts through a table of words, for tokenizers that drop white space.

Such a tokenizer cuts at white space before anything else, so a text's ids are
its words' ids in order.  A task keeps the ids of words (and of the words'
letter, digit and sign runs) it has met; what is not plain Latin goes through
the library as a whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

KEEP = 750_000  # words whose ids a worker remembers; as many of the generation before (some 200 bytes a word)
RUNS = 500_000  # letter, digit and sign runs that it remembers
# Letters and numbers of Latin-1 in lower case; beyond it the library cuts the text.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile("[!-~¡-ÿ]+")


def byte_signs() -> dict[int, str]:
    """The character that byte-level vocabularies use for each byte: itself if it prints, else one above 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SIGNS = byte_signs()
_TO_SIGNS = {c: "".join(_SIGNS[b] for b in chr(c).encode()) for c in range(0x100)}


class WordEncoder:
    """``encode(utf8)`` gives the ids of a whole text as packed little-endian integers of ``kind``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def encode(self, utf8: bytes) -> bytes:
        if any(m in utf8 for m in self.marks):
            return self._whole(utf8.decode())
        words = utf8.split()  # the white space of ASCII, which every \s holds
        table = self.words
        try:
            return b"".join([table[w] for w in words])
        except KeyError:
            if len(table) > KEEP:
                self.older, self.words = table, {}
                table = self.words
            known = self.older.get
            for w in set(words).difference(table):
                table[w] = known(w) or self._word(w.decode())
            return b"".join([table[w] for w in words])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._run(word.lower())
        if not _PLAIN.fullmatch(word):
            return self._whole(word)
        return b"".join([self._run(run) for run in _RUNS.findall(word.lower())])

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) > RUNS:
                self.runs.clear()
            signs = run if run.isascii() and run.isalnum() else run.translate(_TO_SIGNS)
            ids = array(self.kind.char, [t.id for t in self.tokenizer.model.tokenize(signs)]).tobytes()
            self.runs[run] = ids
        return ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker process and path, so that later tasks find the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
