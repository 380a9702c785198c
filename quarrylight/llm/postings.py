"""Packed postings: how blocks of documents send what they hold to hash parts.

A block is a few thousand documents of one task.  For every hash part it sends
one row: the distinct keys of that part, and for each key the documents (as
positions in the block) that hold it and how often.  A part sees every block's
row, works out one value per distinct key, and sends back one sum per document
and block.  Nothing is ever dealt out by document or by key alone, so a key or
a source that a third of the rows share costs one entry per block.
"""

from __future__ import annotations

import numpy as np


class Postings:
    """Key position, document position and count, sorted by key."""

    def __init__(self, docs: np.ndarray, keys: np.ndarray, counts: np.ndarray, n_keys: int):
        self.docs, self.counts = docs, counts
        self.per_key = np.bincount(keys, minlength=n_keys).astype(np.uint32)

    def keys(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_key)), self.per_key)

    def pack(self) -> bytes:
        """Lengths, then documents as 16 or 32 bits and counts as bytes; larger counts take several entries."""
        docs, counts, per_key = self.docs, self.counts, self.per_key
        if len(counts) and counts.max() > 255:
            parts = -(-counts // 255)
            keys = np.repeat(self.keys(), parts)
            last = np.cumsum(parts) - 1
            split = np.full(len(keys), 255, np.int64)
            split[last] = counts - 255 * (parts - 1)
            docs, counts = np.repeat(docs, parts), split
            per_key = np.bincount(keys, minlength=len(per_key)).astype(np.uint32)
        wide = len(docs) and docs.max() > 0xFFFF
        head = np.array([len(per_key), len(docs), wide], np.uint32)
        return b"".join((head.tobytes(), per_key.tobytes(), docs.astype(np.uint32 if wide else np.uint16).tobytes(), counts.astype(np.uint8).tobytes()))

    @classmethod
    def unpack(cls, data: bytes) -> Postings:
        n_keys, n, wide = np.frombuffer(data, np.uint32, 3).tolist()
        out = cls.__new__(cls)
        out.per_key = np.frombuffer(data, np.uint32, n_keys, 12)
        at = 12 + 4 * n_keys
        out.docs = np.frombuffer(data, np.uint32 if wide else np.uint16, n, at)
        out.counts = np.frombuffer(data, np.uint8, n, at + n * (4 if wide else 2))
        return out

    def sums(self, values: np.ndarray, n_docs: int) -> np.ndarray:
        """Per document, the sum of its keys' values times their counts."""
        return np.bincount(self.docs, np.repeat(values, self.per_key) * self.counts, minlength=n_docs)


def by_part(parts: np.ndarray, n_parts: int) -> list[np.ndarray]:
    """Positions of the keys of each part."""
    order = np.argsort(parts, kind="stable")
    return np.split(order, np.searchsorted(parts[order], np.arange(1, n_parts)))


def select(docs: np.ndarray, keys: np.ndarray, counts: np.ndarray, parts: np.ndarray, n_parts: int):
    """Yields, for each part, its key positions and their postings."""
    groups = by_part(parts, n_parts)
    rank = np.empty(len(parts), np.int32)  # keys in order of part
    rank[np.concatenate(groups)] = np.arange(len(parts))
    order = np.argsort(rank[keys], kind="stable")
    docs, counts, rank = docs[order], counts[order], rank[keys][order]
    edges = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
    cuts = np.searchsorted(rank, edges)
    for p, group in enumerate(groups):
        lo, hi = cuts[p], cuts[p + 1]
        yield group, Postings(docs[lo:hi], rank[lo:hi] - edges[p], counts[lo:hi], len(group))
