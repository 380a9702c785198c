"""Terms of texts: runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.

Everything works on the bytes of a chunk of texts at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from quarrylight.llm.textops import LONG_SPAN, byte_view, span_hashes

_INSIDE = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _INSIDE[_lo:_hi] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Terms:
    """Where the terms of some texts lie: byte starts and ends, each term's row, and terms per row."""

    def __init__(self, texts: pa.Array):
        raw, offsets = byte_view(texts)
        self.bytes = _LOWER[raw]
        inside = _INSIDE[raw]
        gap_before, gap_after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        np.logical_not(inside[:-1], out=gap_before[1:])
        np.logical_not(inside[1:], out=gap_after[:-1])
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        gap_before[edges] = True
        gap_after[edges - 1] = True
        self.starts = np.flatnonzero(inside & gap_before)
        self.ends = np.flatnonzero(inside & gap_after) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(texts)).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each term's bytes."""
        return span_hashes(self.bytes, self.starts, self.ends)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of each span, going on from what ``before`` has for it."""
    size = ends - starts
    given = np.zeros(len(size), np.uint32) if before is None else before
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], -size[order]
    state = ~given[order]
    for k in range(min(int(size.max(initial=0)), LONG_SPAN)):
        n = np.searchsorted(left, -k)  # spans of over k bytes come first
        state[:n] = _step(state[:n], data[at[:n] + k])
    out = np.empty_like(state)
    out[order] = ~state
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(given[i]))
    return out


def bigram_crc32(terms: Terms, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and CRC-32 of each two consecutive terms of a text, joined by one space; ``single`` has the terms' own."""
    pairs = np.flatnonzero(terms.row[1:] == terms.row[:-1])
    spaced = ~_step(~single[pairs], np.uint32(0x20))
    return terms.row[pairs], crc32(terms.bytes, terms.starts[pairs + 1], terms.ends[pairs + 1], spaced)
