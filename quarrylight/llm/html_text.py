"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level boundaries.
Each block is a vector of its tag path, the hashed words of its class and id
names, its own hashed words and a few measures; a bidirectional LSTM in numpy
reads the whole sequence of a page and gives every block a chance of being
article text.  The blocks over one half are joined.  The weights were trained
by :mod:`quarrylight.llm.html_train` on pages that it makes up, and lie beside
this module.

Defined results for odd input: null, empty or textless html gives an empty
text; comments end as in the HTML standard (``-->``, ``--!>``, and at once in
``<!-->``); unclosed elements end where their parents end, a tag cut off by the
end is dropped, and an unclosed comment, script or style runs to the end;
repeated rows and ids are extracted each; an empty table gives an empty result;
only the id, url and html columns are read.  A page of any length is read whole:
one of more than SEGMENT blocks in segments, with the network's state carried on
in either direction, and nesting of any depth costs one entry a level.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import textops
from quarrylight.llm.graph import bounded_batches

WEIGHTS = Path(__file__).with_name("html_weights.npz")
HIDDEN = 24
#: Blocks of a page that are read at once.
SEGMENT = 20_000
#: The tags that have a place of their own in a block's vector.
TAGS = (
    "article main section div nav header footer aside form ul ol li dl dt dd table tr td th p h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption details summary menu fieldset legend select option button label a address dialog"
).split()
#: Elements whose start and end bound a block.
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without content, and elements whose content is never shown as text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = set("script style title noscript template iframe noembed noframes textarea svg".split())
#: Elements that a new sibling of the same kind closes.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

CLASS_DIMS, WORD_DIMS, MEASURES = 64, 32, 8
DIMS = len(TAGS) + CLASS_DIMS + WORD_DIMS + MEASURES

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+")
_TAG_PLACE = {t: i for i, t in enumerate(TAGS)}


class Element:
    """An open element: its tag and the elements around it."""

    __slots__ = ("depth", "names", "parent", "tag", "vector")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.depth = parent.depth + 1 if parent else 1
        self.vector: np.ndarray | None = None

    def path_vector(self) -> np.ndarray:
        """Tags and hashed names of this element and all around it."""
        line: list[Element] = []
        at: Element | None = self
        while at is not None and at.vector is None:
            line.append(at)
            at = at.parent
        v = np.zeros(len(TAGS) + CLASS_DIMS, np.float32) if at is None else at.vector
        for element in reversed(line):
            v = v.copy()
            if element.tag in _TAG_PLACE:
                v[_TAG_PLACE[element.tag]] = 1
            for name in element.names:
                h = crc32(name.encode())
                v[len(TAGS) + h % CLASS_DIMS] += 1 if h & 0x10000 else -1
        self.vector = v
        return v


_NO_PATH = np.zeros(len(TAGS) + CLASS_DIMS, np.float32)


class Block:
    """A leaf block: its text, the element it lies in and how much of it is link text."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, text: str, element: Element | None, linked: int):
        self.text, self.element, self.linked = text, element, linked


def _parts(attributes: str) -> tuple[str, ...]:
    return tuple(w.lower() for x in _NAMES.findall(attributes) for w in _PART.findall(x))


_few_parts = lru_cache(20_000)(_parts)


def _names(attributes: str) -> tuple[str, ...]:
    return _few_parts(attributes) if len(attributes) < 200 else _parts(attributes)


class Open:
    """The open elements, innermost last."""

    def __init__(self):
        self.stack: list[Element] = []
        self.count: Counter[str] = Counter()

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.stack.append(Element(tag, names, self.stack[-1] if self.stack else None))
        self.count[tag] += 1

    def close(self, k: int) -> None:
        for element in self.stack[k:]:
            self.count[element.tag] -= 1
        del self.stack[k:]

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its name, and what that holds."""
        if self.count[tag]:
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self.close(k)

    def imply_ends(self, tag: str) -> None:
        """Closes what a starting block-level element ends: an open paragraph, or a sibling."""
        if not self.count["p"] and not (tag in SIBLINGS and self.count[tag]):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k].tag
            if name == "p" or (name == tag and tag in SIBLINGS):
                self.close(k)
                return
            if name in BLOCKS and (tag not in SIBLINGS or name in SIBLINGS[tag]):
                return


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order, white space collapsed and character references decoded."""
    out: list[Block] = []
    open_ = Open()
    text: list[str] = []
    linked = in_link = at = 0
    element: Element | None = None

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            if "&" in whole:
                whole = html.unescape(whole)
            if whole := " ".join(whole.split()):
                out.append(Block(whole, element, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, element
        if piece:
            if not text:
                element = open_.stack[-1] if open_.stack else None
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if tag in BLOCKS:
            end_block()
        if m[1]:
            in_link = 0 if tag == "a" else in_link
            open_.end(tag)
            continue
        if tag in HIDDEN_TEXT and not (tag == "svg" and m[3].rstrip().endswith("/")):
            close = _end_of(tag).search(page, at)
            at = close.end() if close else n
            continue
        if tag in VOID or tag == "svg":
            continue
        if tag in BLOCKS:
            open_.imply_ends(tag)
        if tag == "a":
            in_link = 1
        if not m[3].rstrip().endswith("/") or tag in BLOCKS or tag == "a":
            open_.push(tag, _names(m[3]))
    end_block()
    return out


@lru_cache(32)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE)


def shares(first: np.ndarray) -> np.ndarray:
    """How far into its page each block lies, from 0 to 1."""
    sizes = np.diff(first)
    return (np.arange(first[-1]) - np.repeat(first[:-1], sizes)) / np.repeat(np.maximum(sizes, 1), sizes)


def vectors(blocks: list[Block], share: np.ndarray) -> np.ndarray:
    """One row per block; ``share`` tells how far into its page each lies."""
    out = np.zeros((len(blocks), DIMS), np.float32)
    if not blocks:
        return out
    at = len(TAGS) + CLASS_DIMS
    for i, b in enumerate(blocks):
        out[i, :at] = b.element.path_vector() if b.element else _NO_PATH
    texts = pa.array([b.text for b in blocks], pa.large_string())
    chars = np.array([len(b.text) for b in blocks], np.float32)
    n_words = np.zeros(len(blocks))
    ends = np.zeros(len(blocks))
    for lo, hi in textops.chunks(texts):
        words = textops.Words(texts.slice(lo, hi - lo))
        h = words.hashes()
        place = words.row * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64)
        sign = np.where(h & np.uint64(1 << 40), 1.0, -1.0)
        out[lo:hi, at : at + WORD_DIMS] = np.bincount(place, sign, (hi - lo) * WORD_DIMS).reshape(-1, WORD_DIMS)
        n_words[lo:hi] = words.counts
        stops = np.isin(words.bytes, np.frombuffer(b".,;:!?", np.uint8))
        ends[lo:hi] = np.diff(np.concatenate(([0], np.cumsum(stops)))[words.offsets])
    out[:, at : at + WORD_DIMS] = np.clip(out[:, at : at + WORD_DIMS] / (4 * np.sqrt(np.maximum(n_words, 1))[:, None]), -1, 1)
    m = out[:, at + WORD_DIMS :]
    m[:, 0] = np.minimum(np.log1p(chars), 9) / 8
    m[:, 1] = np.minimum(np.array([b.linked for b in blocks]) / np.maximum(chars, 1), 1)
    m[:, 2] = np.minimum(ends / np.maximum(n_words, 1), 1)
    m[:, 3] = share
    m[:, 4] = np.minimum(np.array([b.element.depth if b.element else 0 for b in blocks]) / 10, 2)
    m[:, 5] = np.array(["©" in b.text for b in blocks])
    m[:, 6] = np.minimum(n_words, 3) / 3
    m[:, 7] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, wh: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Outputs after each step, and the last state; x (pages, steps, 4 * HIDDEN) holds the inputs' share of the gates."""
    pages, steps, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype))
    out = np.empty((pages, steps, HIDDEN), x.dtype)
    for t in range(steps):
        g = x[:, t] + h @ wh
        s = _sigmoid(g[:, : 3 * HIDDEN])
        c = s[:, :HIDDEN] * c + s[:, HIDDEN : 2 * HIDDEN] * np.tanh(g[:, 3 * HIDDEN :])
        h = s[:, 2 * HIDDEN :] * np.tanh(c)
        out[:, t] = h
    return out, (h, c)


class Labeller:
    """The trained network."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    def chances(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each block's chance of being article text, pages of like length together."""
        out = np.zeros(len(x))
        sizes = np.diff(first)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        lo = 0
        while lo < len(order):
            hi = lo + 1  # at most 256 pages and about 100,000 steps a batch
            while hi < len(order) and hi - lo < 256 and (hi - lo) * sizes[order[hi]] < 100_000:
                hi += 1
            own = order[lo:hi]
            steps = sizes[own].max()
            # place of each step in x, forwards and backwards; steps after a page's end repeat its last one
            step = np.minimum(np.arange(steps)[None, :], sizes[own][:, None] - 1)
            ahead = first[own][:, None] + step
            behind = first[own][:, None] + (sizes[own][:, None] - 1 - step)
            f, _ = lstm(x[ahead] @ self.w["fx"], self.w["fh"])
            b, _ = lstm(x[behind] @ self.w["bx"], self.w["bh"])
            turned = np.take_along_axis(b, (sizes[own][:, None] - 1 - step)[:, :, None], 1)
            z = f @ self.w["of"] + turned @ self.w["ob"] + self.w["o"]
            real = np.arange(steps)[None, :] < sizes[own][:, None]
            out[ahead[real]] = _sigmoid(z[real])
            lo = hi
        return out

    def long_chances(self, blocks: list[Block]) -> np.ndarray:
        """As :meth:`chances` for one long page, a segment at a time: only one number a block is kept."""
        n = len(blocks)
        z = np.full(n, self.w["o"], np.float64)
        cuts = [(lo, min(lo + SEGMENT, n)) for lo in range(0, n, SEGMENT)]
        for gates, own, out, turned in (("fx", "fh", "of", False), ("bx", "bh", "ob", True)):
            state = None
            for lo, hi in reversed(cuts) if turned else cuts:
                x = vectors(blocks[lo:hi], np.arange(lo, hi) / n)
                x = x[::-1] if turned else x
                steps, state = lstm((x @ self.w[gates])[None], self.w[own], state)
                part = steps[0] @ self.w[out]
                z[lo:hi] += part[::-1] if turned else part
        return _sigmoid(z)

    def texts(self, pages: list[str | None]) -> list[str]:
        blocks = [leaf_blocks(p) if p else [] for p in pages]
        short = [b if len(b) <= SEGMENT else [] for b in blocks]
        first = np.concatenate(([0], np.cumsum([len(b) for b in short]))).astype(np.int64)
        flat = [b for own in short for b in own]
        chances = self.chances(vectors(flat, shares(first)), first)
        out = []
        for own, lo, hi in zip(blocks, first[:-1], first[1:], strict=True):
            likely = chances[lo:hi] if len(own) <= SEGMENT else self.long_chances(own)
            out.append("\n".join(b.text for b, p in zip(own, likely, strict=True) if p >= 0.5))
        return out


def load_weights(path: Path = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as data:
        return dict(data)


def _extract(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights)
        for batch in batches:
            for lo, hi in textops.chunks(batch.column(2)):
                texts = labeller.texts(batch.column(2).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, main text and its length in code points."""
    bounded_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(source.dtypes)
    texts = source.mapInArrow(_extract(load_weights()), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return texts.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
