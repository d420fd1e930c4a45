"""Vectorised word splitting and hashing over the raw UTF-8 bytes of Arrow text columns.

A text column of an Arrow batch is one byte buffer plus offsets. Words, their
positions and 64-bit word hashes are found with a fixed number of numpy passes over
those bytes, so no Python code runs per word. Chunks hold whole texts of at most
``CHUNK_BYTES`` bytes together (one longer text is a chunk of its own), which bounds
the working memory per task.

Both word rules in use (separators, or word characters) treat every byte of a
multi-byte UTF-8 character alike, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64


def _space_words() -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    lut[0x20] = False
    lut[0x09:0x0E] = False
    return lut


def _alnum_words() -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    lut[0x30:0x3A] = True
    lut[0x41:0x5B] = True
    lut[0x61:0x7B] = True
    lut[0x80:] = True
    return lut


#: words are runs of anything but space and \x09-\x0D
SPACE_WORDS = _space_words()
#: words are runs of ASCII letters, digits and non-ASCII characters
ALNUM_WORDS = _alnum_words()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values(seed: int, fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))
    if fold:  # A-Z count as a-z
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[name] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """Words of a chunk: byte spans, owning text, and each text's first word."""
    data: np.ndarray     # bytes of the chunk
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # one past the last byte
    doc: np.ndarray      # index of the text, within the chunk
    first: np.ndarray    # index of each text's first word; n_texts + 1 entries
    n_docs: int

    def hashes(self, seed: int = 0, fold: bool = True) -> np.ndarray:
        """64-bit hash of each word, A-Z folded to a-z if ``fold``."""
        if len(self.start) == 0:
            return np.empty(0, dtype=np.uint64)
        n = len(self.data)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_byte_values(seed, fold)[self.data] * _power("r", _R, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _power("inv", _R_INV, n)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def text_chunks(column) -> "list[tuple[int, int, np.ndarray, np.ndarray]]":
    """Yield (first text, one past last, bytes, offsets) of whole-text chunks of an
    Arrow string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32,
                            count=n + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Find the words of a chunk. A word never spans two texts."""
    n_docs = len(offsets) - 1
    if len(data) == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(data, none, none, none, np.zeros(n_docs + 1, dtype=np.int64), n_docs)
    inside = word_bytes[data]
    cut = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets, side="left")
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(data, start, end, doc, first, n_docs)


def windows(h: np.ndarray, first: np.ndarray, width: int, seed: int = 0):
    """Hash of every run of ``width`` consecutive words within a text.

    Returns (hash, text index, first word). A text with fewer words, but not none,
    is one run of all its words.
    """
    n_words = np.diff(first)
    count = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n_words)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    left = np.minimum(np.repeat(n_words, count), width)
    padded = np.concatenate([h, np.zeros(width, dtype=np.uint64)])
    out = np.full(len(at), seed, dtype=np.uint64)
    for k in range(width):
        word = padded[at + k]
        if (left <= k).any():
            word = np.where(left > k, word, _U(0x5851F42D4C957F2D))
        out = out * _U(0xD1342543DE82EF95) + word
    return mix(out), doc, at
