"""lexical_tokens() within tasks: tokens of many texts at once, on Arrow's buffers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import FIRST_CJK

_MARKS = b"+#._-"  # may stand within a word, not before it; of these `+` and `#` may end it
#: A byte by byte table: letters folded, digits and marks as they are, all else blank.
_BLANKED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c in _MARKS else 32 for c in range(256))
_PIECES = re.compile("[㐀-䶿一-鿿]+|[a-z0-9][a-z0-9+#._-]*")


def _mixed(text: bytes) -> str:
    """The tokens of a text that may have CJK, with blanks between."""
    found: list[str] = []
    for piece in _PIECES.findall(text.lower().decode(errors="replace")):  # bytes fold A-Z only
        found.extend([piece[i : i + 2] for i in range(len(piece) - 1)] if piece >= FIRST_CJK and len(piece) > 1 else [piece])
    return " ".join(found)


def text_parts(batch: pa.RecordBatch, column: int, rows: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows, and about so many bytes of text: one text, if it is longer."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(batch):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokens_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words) of some texts: their tokens in order, each with its text's place and its own place in the distinct words.

    No text is walked in Python but those that may hold CJK.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = held.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if held is not None else b""
    at = (offsets - offsets[0]).astype(np.int32)
    blanked = pa.StringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(raw.translate(_BLANKED)))
    first = np.frombuffer(raw, np.uint8)
    high = np.flatnonzero((first >= 0xE3) & (first <= 0xE9))  # bytes that U+3000 to U+9FFF begin with
    if len(high):
        some = blanked.to_pylist()
        for i in np.unique(np.searchsorted(at, high, "right") - 1).tolist():
            some[i] = _mixed(raw[at[i] : at[i + 1]])
        blanked = pa.array(some, pa.string())
    pieces = pc.ascii_split_whitespace(blanked)
    coded = pieces.flatten().dictionary_encode()
    clean = pc.ascii_rtrim(pc.ascii_ltrim(coded.dictionary, "+#._-"), "._-").dictionary_encode()
    code = clean.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64) if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), pieces.value_lengths().to_numpy())
    kept = (pc.binary_length(clean.dictionary).to_numpy() > 0)[code] if len(code) else np.zeros(0, bool)
    return row[kept], code[kept], clean.dictionary
