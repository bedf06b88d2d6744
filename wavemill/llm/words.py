"""Words of Arrow text batches as integer codes, by array steps over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are read in slices of about so many bytes, which bounds the working arrays; a longer text is a slice alone.
SLICE_BYTES = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the 256 bytes that is true inside the given inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


@dataclass
class Words:
    """The words of a slice of rows, in order.

    ``text`` holds the words with A-Z lower-cased, ``row`` the row of each (from the slice's first),
    ``counts`` the number of words by row, ``broken`` whether another piece or row begins after a
    word (given only where pieces were asked for), and ``start``, ``end`` the byte places of a word in its row.
    """

    text: pa.Array
    row: np.ndarray
    counts: np.ndarray
    broken: np.ndarray | None
    start: np.ndarray
    end: np.ndarray


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the first row and byte offsets of slices of a string array."""
    kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind.itemsize)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, offsets[at : upto + 1].astype(np.int64)
        at = upto


def split_words(texts: pa.Array, inside: np.ndarray, breaks: np.ndarray | None = None) -> Iterator[tuple[int, Words]]:
    """The words (runs of bytes ``inside``) of string rows; null rows have none.

    ``breaks`` are bytes, outside of words, that end a piece. Yields the number of the first row
    of each slice with its words.
    """
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for first, offsets in _slices(texts):
        own = whole[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        word = inside[own]
        if len(own) == 0:
            none = np.zeros(0, np.int64)
            yield first, Words(pa.array([], pa.string()), none, np.zeros(len(bounds) - 1, np.int64), none.astype(bool), none, none)
            continue
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(own))]
        opens[inner] = word[inner]
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        closes[inner - 1] = word[inner - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        del opens, closes
        places = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=places[1:])
        letters = _LOWER[own[word]]
        text = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(letters))
        upto = np.searchsorted(start, bounds)  # words before each row
        counts = np.diff(upto)
        row = np.repeat(np.arange(len(counts)), counts)
        broken = None
        if breaks is not None:
            seen = np.cumsum(breaks[own], dtype=np.int32)
            broken = np.ones(len(start), bool)
            if len(start):
                broken[:-1] = (seen[start[1:]] != seen[start[:-1]]) | (row[1:] != row[:-1])
        shift = bounds[:-1][row]
        yield first, Words(text, row, counts, broken, start - shift, end - shift)


def coded(words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Codes of words given in chunks, and the dictionary that they point into."""
    chunks = pa.chunked_array(words, pa.string()).dictionary_encode().combine_chunks()
    if isinstance(chunks, pa.ChunkedArray):
        chunks = chunks.chunk(0) if chunks.num_chunks else pa.array([], pa.dictionary(pa.int32(), pa.string()))
    return chunks.indices.to_numpy(zero_copy_only=False), chunks.dictionary
