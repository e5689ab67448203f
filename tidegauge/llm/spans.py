"""Words of many texts at once, as places in the bytes that Arrow holds them in."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """Words of texts in order: the bytes of all words one after another, where each ends, and the number of its text."""

    data: np.ndarray
    ends: np.ndarray
    text: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def codes(self) -> tuple[np.ndarray, int]:
        """A number for each word, equal for equal words, and how many there are."""
        offsets = np.concatenate([[0], self.ends]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data))]).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), len(found.dictionary)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one blank after each, and where each starts there."""
        sizes = self.sizes
        out = np.full(len(self.data) + len(sizes), 32, np.uint8)
        out[np.arange(len(self.data)) + np.repeat(np.arange(len(sizes)), sizes)] = self.data
        return out, self.ends - sizes + np.arange(len(sizes))


def words_of(texts: pa.Array, is_word: np.ndarray, as_byte: np.ndarray | None = None) -> Words:
    """The words of UTF-8 texts (null: none): longest runs of bytes for which is_word holds, after each byte b became as_byte[b]."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and len(at) else np.zeros(0, np.uint8)
    at = at - at[0]
    if as_byte is not None:
        raw = as_byte[raw]
    own = is_word[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    before, after = np.concatenate([[False], own[:-1]]), np.concatenate([own[1:], [False]])
    starts = np.flatnonzero(own & (~before | cut[:-1]))
    sizes = np.flatnonzero(own & (~after | cut[1:])) + 1 - starts
    return Words(raw[own], np.cumsum(sizes), np.searchsorted(at, starts, "right") - 1)
