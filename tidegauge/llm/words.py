"""A lower-casing word BPE, with the ids of recurring words remembered in each Python worker."""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import regex
from tokenizers import Tokenizer

#: The file's own special tokens, which it finds in raw text before all else.
SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")
#: Other characters than these may change under NFC, or be white space or letters for one library only.
UNUSUAL = re.compile("[^\t\n\r -~\xa1-\u024f\u2010-\u2027\u20ac]")
#: Fixed value: the split pattern in word_bpe_49k.json.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Byte-level tokenizers write bytes as printable characters: these as themselves, the others in order from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
PRINTABLE = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}


class Remembered(dict):
    """A cache of a bounded number of entries: it starts anew when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, just as the tokenizers library does with the same file.

    Tokens never cross white space, and the file's words are encoded each by itself. So a text of usual
    characters is split at white space and each part looked up; any other text goes to the library whole.
    """

    def __init__(self, path: str, most: int = 350_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.words = Remembered(self._word, most)
        self.parts = Remembered(self._part, most)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One match of WORD by the file's model alone, which takes bytes as printable characters."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(PRINTABLE))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORD.findall(part)))

    def __call__(self, text: str) -> bytes:
        if UNUSUAL.search(text) or "<|" in text and SPECIAL.search(text):
            return self._library(text)
        return b"".join(map(self.parts.__getitem__, text.lower().split()))


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker and file."""
    return WordEncoder(path)
