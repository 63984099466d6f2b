"""Words of whole texts as arrays: what operators that compare words in tasks need."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of texts that are held as words at once; a longer text is held alone.
SLICE = 1 << 20


@dataclass
class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, in order; text i has those from starts[i] to starts[i + 1].

    raw: all bytes of the texts, text i from bounds[i] to bounds[i + 1]. lengths: bytes of each word. codes: a number for
    each word, equal for equal words; kinds: the word of each number.
    """

    first: int
    raw: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    kinds: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def _split(raw: np.ndarray, bounds: np.ndarray, first: int) -> Words:
    inner = ~_WHITE[raw]
    opens = inner.copy()
    opens[1:] &= ~inner[:-1]
    begins = bounds[:-1][bounds[:-1] < len(raw)]
    opens[begins] = inner[begins]  # a text's first byte never goes on with the word before
    at = np.flatnonzero(opens)
    packed = raw[inner]
    offsets = np.append(np.cumsum(inner)[at] - 1, len(packed)) if len(at) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return Words(first, raw, bounds, np.searchsorted(at, bounds), np.diff(offsets), coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[Words]:
    """The words of a column of UTF-8 texts (binary; null: none), some texts at a time."""
    texts = pc.fill_null(texts, b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield _split(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first)
        first = last
