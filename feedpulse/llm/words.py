"""Words and word windows of whole texts, by numpy over Arrow buffers.

Runs inside tasks (``mapInArrow``).  A batch is cut into chunks of whole texts of a
few MB, so memory follows the chunk (or the one longest text), not the partition.
Words get a 64-bit hash: a polynomial over their bytes with random byte values,
finished by a mixing step.  Windows of words get one over their word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93

#: Byte classes; bytes of multi-byte characters are always word bytes.
BLANK_SPLIT, ALNUM_SPLIT, ALPHA_SPLIT = "blank", "alnum", "alpha"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _word_bytes(split: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[0x80:] = True
    if split == BLANK_SPLIT:
        table[:] = True
        table[0x20] = False
        table[0x09:0x0E] = False
    else:
        table[ord("0"):ord("9") + 1] = split == ALNUM_SPLIT
        table[ord("a"):ord("z") + 1] = True
        table[ord("A"):ord("Z") + 1] = True
    return table


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    if lower:
        values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (the base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
                     for b in (base, inverse))
        if size <= 1 << 22:  # what one very long text needs is not kept
            _POWERS[base] = have
    return have


def _spans(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span."""
    power, inverse = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[:len(values)], dtype=np.uint64, out=total[1:])
    return (total[end] - total[start]) * inverse[start]


@dataclass
class Words:
    """Words of the texts of one chunk, in order."""

    data: np.ndarray   # bytes of the chunk
    first: np.ndarray  # per text: index of its first word; one more entry at the end
    start: np.ndarray  # per word: first byte
    end: np.ndarray    # per word: byte after the last
    hash: np.ndarray   # per word

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; meaningful where ``fits``."""
        n = len(self.hash)
        if n < size:
            return np.zeros(n, dtype=np.uint64)
        at = np.arange(n - size + 1)
        out = np.zeros(n, dtype=np.uint64)
        out[:n - size + 1] = mix(_spans(self.hash, _WORD_BASE, at, at + size) ^ _U(size))
        return out

    def fits(self, size: int) -> np.ndarray:
        """Whether a window of ``size`` words from here on stays inside its text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.hash)) + size <= last

    def whole(self) -> np.ndarray:
        """Hash of each text's word sequence."""
        return mix(_spans(self.hash, _WORD_BASE, self.first[:-1], self.first[1:])
                   ^ np.diff(self.first).astype(np.uint64))


def prefix_hashes(words: Words, lengths: tuple[int, ...], lower: bool) -> list[np.ndarray]:
    """For each length in bytes: the hash of each word's prefix (of the whole word if shorter)."""
    values = _byte_values(lower)[words.data]
    power, inverse = _powers(_BYTE_BASE, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[:len(values)], dtype=np.uint64, out=total[1:])
    ends = [np.minimum(words.start + n, words.end) for n in lengths]
    return [mix((total[end] - total[words.start]) * inverse[words.start]) for end in ends]


def split_words(data: np.ndarray, offsets: np.ndarray, split: str, lower: bool) -> Words:
    is_word = _word_bytes(split)[data]
    n = len(data)
    before = np.zeros(n, dtype=bool)
    before[1:] = is_word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = is_word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    hashed = _spans(_byte_values(lower)[data], _BYTE_BASE, start, end)
    hashed = mix(hashed ^ (end - start).astype(np.uint64))
    return Words(data, np.searchsorted(start, offsets), start, end, hashed)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str, split: str = BLANK_SPLIT, lower: bool = False,
           chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Whole texts of a batch, a few MB at a time."""
    if not batch.num_rows:
        return
    data, offsets = text_buffers(batch.column(text))
    row = 0
    while row < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        upto = min(max(upto, row + 1), batch.num_rows)
        at = offsets[row:upto + 1]
        yield batch.slice(row, upto - row), split_words(data[at[0]:at[-1]], at - at[0], split, lower)
        row = upto


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of at most ``limit`` bytes, or of one text that is longer."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        upto = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        upto = min(max(upto, row + 1), rows)
        yield row, upto
        row = upto


def word_strings(data: np.ndarray, offsets: np.ndarray, split: str, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one string array, and each text's first word in it (one more
    entry at the end)."""
    is_word = _word_bytes(split)[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = is_word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(is_word & ~before)
    at = np.cumsum(is_word, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    letters = data[is_word]
    if lower:
        letters = np.where((letters >= ord("A")) & (letters <= ord("Z")), letters + np.uint8(32), letters)
    begin = np.append(at[start].astype(np.int64) - 1, len(letters))
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(begin), pa.py_buffer(letters)])
    return found, np.searchsorted(start, offsets)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    data, offsets = text_buffers(strings)
    hashed = _spans(_byte_values(False)[data], _BYTE_BASE, offsets[:-1], offsets[1:])
    return mix(hashed ^ np.diff(offsets).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
