"""Vectorised text primitives over Arrow string arrays.

Words are runs of bytes other than space and U+0009 to U+000D.  Everything here
works on the bytes of a whole chunk of texts at once; a chunk holds about
CHUNK_BYTES of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, most: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, and of ``rows`` rows at most."""
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    lo = total = 0
    for i, size in enumerate(sizes):
        if (total and total + size > most) or i - lo >= rows:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and len + 1 offsets; null is empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans longer than this are hashed one by one.
LONG_SPAN = 64


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's length and bytes.

    Every eight bytes are mixed into what came before, so spans of up to eight
    bytes and one length never collide, and no structure of longer ones carries
    over to their hashes.
    """
    size, view = ends - starts, eights(data)
    h = mix(size.astype(np.uint64))
    if not len(size):
        return h
    at = np.arange(len(size))
    for k in range(0, min(int(size.max()), LONG_SPAN), 8):
        if k:
            at = at[size[at] > k]
        part = view[starts[at] + k] & _MASKS[np.minimum(size[at] - k, 8)]
        h[at] = mix(h[at] ^ part)
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """Where the words of a chunk lie: byte starts and ends, and each word's row."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        raw, self.offsets = byte_view(texts)
        self.bytes = _LOWER[raw] if lower else raw
        space = _SPACE[raw]
        before, after = np.empty_like(space), np.empty_like(space)
        if len(raw):
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
            edges = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
            before[edges] = True
            after[edges - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(texts)).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.bytes, self.starts, self.ends)


_SEQUENCE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    words = Words(texts)
    h = words.hashes()
    first = np.concatenate(([0], np.cumsum(words.counts)))
    runs = max(len(h) - width + 1, 0)
    rolled = np.zeros(runs, np.uint64)
    for k in range(width):
        rolled += h[k : k + runs] * _SEQUENCE[k]
    rolled = mix(rolled)
    sets = []
    for lo, n in zip(first[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= width:
            s = np.sort(rolled[lo : lo + n - width + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif n:
            terms = np.append(h[lo : lo + n] * _SEQUENCE[:n], _SEQUENCE[32 + n])
            sets.append(mix(terms.sum(dtype=np.uint64, keepdims=True)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
