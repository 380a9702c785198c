"""Sum-of-squares online packing into token windows.

Each task packs its own documents, in order, with no shuffle.  What a document
has beyond full windows is placed into the fill level that leaves the smallest
sum of squared counts of partly filled windows per level (a fresh window is
level 0); the counts are one array over levels.  Every document is placed so.

Memory is bounded by ``max_open`` windows: when one more is open, the fullest is
filled up from the emptiest, whose last document is cut if need be.  When a task
ends, levels that fill each other up are joined first, then the rest the same
way, and the last window is cut into powers of two, which need no padding.  So
every window is full or a power of two.

Defined results for odd input: a null or empty text has only the end token;
texts of any length are packed whole; repeated rows and ids are packed each;
levels that tie go to the fullest; an empty table gives an empty result; only
the id and text columns are read.  Window numbers hold the task's number, so
they depend on how the input is split, but not on which executor runs it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.graph import bounded_batches
from quarrylight.llm.token_counts import LETTERS, NUMBERS, PLAIN

MAX_OPEN = 4096
#: Words whose ids a worker keeps.
CACHED = 150_000


class WordEnd(dict):
    """Ids of a tokenizer file whose words end in a marked piece, cached by word.

    The merges run in a byte-pair library: each byte becomes two, a flag that
    tells a word's last byte from the others, and the byte itself; the flags
    never occur in UTF-8.  A word's ids are kept as packed 32-bit integers.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {}
        for token, i in vocabulary.items():
            last = token.endswith("</w>") and len(token) > 4
            ranks[_flagged(bytes(byte_of[c] for c in (token[:-4] if last else token)), last)] = i
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+").findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        self[word] = ids = array("I", self.merge(_flagged(word.encode(), True))).tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        """The text's ids, packed."""
        if PLAIN.fullmatch(text) and not (self.special and "<|" in text and self.special.search(text)):
            # such characters are composed already
            return b"".join(map(self.__getitem__, self.find(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(1)
def _words(path: str) -> WordEnd:
    """One cache of words per worker process."""
    return WordEnd(path)


def _flagged(word: bytes, last: bool) -> bytes:
    out = bytearray(2 * len(word))
    out[0::2], out[1::2] = b"\xf8" * len(word), word
    if last and word:
        out[-2] = 0xF9
    return bytes(out)


class Packer:
    """One task's windows; a piece is (row, start, ids)."""

    def __init__(self, window: int, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.done: list[list] = []
        #: Tokens of windows that placement alone filled, and of all.
        self.placed = self.total = 0

    def _take(self, level: int) -> list:
        pieces = self.open[level].pop()
        self.counts[level] -= 1
        self.n_open -= 1
        if not self.open[level]:
            del self.open[level]
        return pieces

    def _put(self, level: int, pieces: list) -> None:
        if level == self.window:
            self.done.append(pieces)
        elif level:
            self.open.setdefault(level, []).append(pieces)
            self.counts[level] += 1
            self.n_open += 1

    def place(self, row, ids: bytes) -> None:
        size, full = len(ids) // 4, self.window
        self.total += size
        start = size - size % full
        for at in range(0, start, full):
            self.done.append([(row, at, ids[4 * at : 4 * (at + full)])])
        self.placed += start
        if rest := size - start:
            level = self._level(rest)
            pieces = self._take(level) if level else []
            pieces.append((row, start, ids[4 * start :]))
            self._put(level + rest, pieces)
            self.placed += full * (level + rest == full)
            if self.n_open > self.max_open:
                self._fill_one()

    def _fill_one(self) -> None:
        """Fills the fullest open window up from the emptiest."""
        high = max(self.open)
        pieces = self._take(high)
        room = self.window - high
        while room and self.n_open:
            level = min(self.open)
            source = self._take(level)
            while room and source:
                row, start, ids = source.pop()
                n = min(room, len(ids) // 4)
                pieces.append((row, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    source.append((row, start + n, ids[4 * n :]))
                room, level = room - n, level - n
            self._put(level, source)
        self._put(self.window - room, pieces)

    def _level(self, size: int) -> int:
        """The level whose choice adds least to the sum of squared counts; the fuller one on a tie."""
        top = self.window - size
        change = np.full(top + 1, np.iinfo(np.int64).max)
        here = self.counts[1 : top + 1]
        after = 2 * self.counts[1 + size : top + 1 + size] + 1
        if top:
            after[-1] = 0  # a full window leaves the counts
            change[1:] = np.where(here > 0, after - 2 * here + 1, change[1:])
            change[0] = 2 * self.counts[size] + 1
            return top - int(np.argmin(change[::-1]))
        return 0

    def finish(self) -> None:
        """Closes all that is open: complementary levels, then the fullest from the emptiest, at last powers of two."""
        for level in sorted(self.open):
            other = self.window - level
            while level < other and level in self.open and other in self.open:
                self.done.append(self._take(other) + self._take(level))
                self.placed += self.window
            while level == other and len(self.open.get(level, ())) > 1:
                self.done.append(self._take(level) + self._take(level))
                self.placed += self.window
        while self.n_open > 1:
            self._fill_one()
        for level in list(self.open):
            pieces, left = self._take(level)[::-1], level
            while left:
                room, now = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    row, start, ids = pieces.pop()
                    n = min(room, len(ids) // 4)
                    now.append((row, start, ids[: 4 * n]))
                    if 4 * n < len(ids):
                        pieces.append((row, start + n, ids[4 * n :]))
                    room -= n
                self.done.append(now)

    def take(self) -> list[list]:
        out, self.done = self.done, []
        return out


def _pack(path: str, end: int, window: int, max_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = _words(path), Packer(window, max_open)
        number, tail = TaskContext.get().partitionId() << 40, np.array([end], "<u4").tobytes()

        def rows(windows: list[list]) -> pa.RecordBatch:
            nonlocal number
            flat = []
            for w in windows:
                offset = 0
                for (doc, total), start, ids in w:
                    flat.append((doc, start, len(ids) // 4, ids, total, number, offset))
                    offset += len(ids) // 4
                number += 1
            doc, start, length, ids, total, sequence, offset = zip(*flat, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(doc), long(start), long(length), pa.array(ids, pa.binary()), long(total), long(sequence), long(offset)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = words.ids(text or "") + tail
                packer.place((batch.column(0).slice(i, 1), len(ids) // 4), ids)
                if len(packer.done) >= 256:
                    yield rows(packer.take())
        packer.finish()
        done = packer.take()
        for lo in range(0, len(done), 256):
            yield rows(done[lo : lo + 256])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end: int = 1, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: its document, place in it and in its window, and its ids as packed little-endian 32-bit integers."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    packed = source.mapInArrow(_pack(tokenizer_path, end, window, max_open), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("doc_id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
