"""Token counts by distinct pre-token.

A tokenizer's pieces never cross pre-tokens, so a document's count is the sum
over its pre-tokens.  Each block of documents sends its distinct pre-tokens and
their per-document frequencies to hash parts (see :mod:`.postings`); a part
counts the pieces of every distinct pre-token once, joins the counts to the
frequencies, and returns partial sums.  A document's ids are never built: only
the library's own for one pre-token at a time, to be counted.

Defined results for odd input: a null text counts as empty (0 bytes, 0 tokens);
the tokenizer's special strings inside a text are one token each, as is the
library's default; repeated rows and ids all stay, one result each; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import textops
from quarrylight.llm.graph import bounded_batches
from quarrylight.llm.postings import Postings, select

#: Text that a block of documents holds, unless one document is longer.
BLOCK_BYTES = 6 << 20
#: Text for which there is one part.
PART_BYTES = 16 << 20
#: Only in texts of these characters do Python and the tokenizers surely agree on
#: what is a letter, a number or white space; others go through the tokenizer.
_PLAIN_RANGES = [(9, 10), (13, 13), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]
_PLAIN_CHARS = [chr(c) for lo, hi in _PLAIN_RANGES for c in range(lo, hi + 1)]
PLAIN = re.compile("[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in _PLAIN_RANGES) + "]*")
#: The letters and the numbers among them and their lower cases, as the insides of a character class.
_CASED = sorted({c for p in _PLAIN_CHARS for c in p + p.lower()})
LETTERS, NUMBERS = ("".join(c for c in _CASED if unicodedata.category(c)[0] == kind) for kind in "LN")


class ByteLevel:
    """Pre-tokens of a byte-level tokenizer file and the pieces of each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+").findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of the text, and how many special strings it has."""
        if self.special is None or not self.special.search(text):
            return self._plain(text), 0
        parts = self.special.split(text)
        return [x for p in parts for x in self._plain(p)], len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.find(text)
        return [text[lo:hi] for _, (lo, hi) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, pieces: list[str]) -> np.ndarray:
        found = []
        for lo in range(0, len(pieces), 4096):
            found += [len(e) for e in self.tokenizer.encode_batch_fast(pieces[lo : lo + 4096], add_special_tokens=False)]
        return np.array(found, np.int64)


@lru_cache(1)
def _level(path: str) -> ByteLevel:
    """One tokenizer per worker process."""
    return ByteLevel(path)


class _Ids(dict):
    """Numbers strings in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _part_of(pieces: list[str], n_parts: int) -> np.ndarray:
    from zlib import crc32

    h = np.fromiter((crc32(p.encode()) for p in pieces), np.uint64, len(pieces))
    return (textops.mix(h) % np.uint64(n_parts)).astype(np.int64)


def _frequencies(path: str, n_parts: int):
    """Documents to one row per block and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, task, made = _level(path), TaskContext.get().partitionId(), 0
        ids, sizes, docs, keys, counts, known, held = [], [], [], [], [], _Ids(), 0

        def block() -> pa.RecordBatch:
            nonlocal made
            pieces = list(known)
            packed = list(select(np.concatenate(docs), np.concatenate(keys), np.concatenate(counts), _part_of(pieces, n_parts), n_parts))
            made += 1
            # ids and sizes go with the first part's row; the others' lists are empty
            once = lambda x: pa.ListArray.from_arrays(pa.array([0] + [len(x)] * n_parts, pa.int32()), x)
            words = [[pieces[i] for i in group] for group, _ in packed]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_parts, dtype=np.int32)), pa.array([(task << 32) + made] * n_parts, pa.int64()), once(pa.concat_arrays(ids)), once(pa.array(sizes, pa.int64())), pa.array([len(sizes)] * n_parts, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array([p.pack() for _, p in packed], pa.binary())],
                ["part", "block", "ids", "sizes", "n_docs", "keys", "postings"],
            )

        for batch in batches:
            texts = batch.column(1)
            offsets = textops.byte_view(texts)[1]
            for i, text in enumerate(texts.to_pylist()):
                pieces, extra = level.split(text or "")
                own = Counter(map(known.__getitem__, pieces))
                if extra:
                    own[known[level.special.search(text).group()]] += extra
                docs.append(np.full(len(own), len(sizes), np.int32))
                keys.append(np.fromiter(own.keys(), np.int32, len(own)))
                counts.append(np.fromiter(own.values(), np.int32, len(own)))
                ids.append(batch.column(0).slice(i, 1))
                sizes.append(int(offsets[i + 1] - offsets[i]))
                held += sizes[-1] + 100
                if held > BLOCK_BYTES:
                    yield block()
                    ids, sizes, docs, keys, counts, known, held = [], [], [], [], [], _Ids(), 0
                    pa.default_memory_pool().release_unused()
        if sizes:
            yield block()

    return run


def _count_part(path: str):
    """All blocks of one part to partial sums per block: each distinct pre-token is counted once."""

    def run(group: pa.Table) -> pa.Table:
        level, known = _level(path), _Ids()
        local = []
        for row in range(group.num_rows):
            local.append(np.fromiter(map(known.__getitem__, group["keys"][row].as_py()), np.int32))
        values = level.count(list(known)) if known else np.zeros(0, np.int64)
        sums = []
        for row, own in enumerate(local):
            posts = Postings.unpack(group["postings"][row].as_py())
            sums.append(posts.sums(values[own], group["n_docs"][row].as_py()).astype(np.int64))
        return pa.table({"block": group["block"], "ids": group["ids"], "sizes": group["sizes"], "sums": pa.array([s.tobytes() for s in sums], pa.binary())})

    return run


def _total(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(s, np.int64) for s in group["sums"].to_pylist()], axis=0)
    return pa.table([pc.list_flatten(group["ids"]), pc.list_flatten(group["sizes"]), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, parts: int | None = None) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether the tokens are over the limit.

    ``parts`` is how many hash parts the pre-tokens are dealt to; the default is
    one for PART_BYTES of text, and one for each core at least.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    size = 0 if parts else source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = parts or max(-(-size // PART_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    sent = source.mapInArrow(_frequencies(tokenizer_path, n_parts), f"part int, block long, ids array<{kind}>, sizes array<long>, n_docs int, keys array<string>, postings binary")
    partial = sent.groupBy("part").applyInArrow(_count_part(tokenizer_path), f"block long, ids array<{kind}>, sizes array<long>, sums binary")
    total = partial.groupBy("block").applyInArrow(_total, f"doc_id {kind}, n_bytes long, n_tokens long")
    return total.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
