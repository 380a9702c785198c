"""Ranked full-text search: postings, BM25, query syntax, snippets, fallbacks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import tokens

#: BM25's constants, as published by Robertson and Zaragoza (2009).
K1, B = 1.2, 0.75

#: An expression: ("word" | "prefix", text), ("phrase", words, prefix), ("and" | "or", parts), ("not", yes, no), ("in", column, part).
Tree = tuple


@dataclass
class Query:
    """A parsed query; no tree where it holds no word."""

    tree: Tree | None = None

    def scored(self) -> list[str]:
        """The words that count for rank, sorted so that sums have one order."""
        words, left = set(), [self.tree] if self.tree else []
        while left:
            kind, *rest = left.pop()
            if kind == "word":
                words.add(rest[0])
            elif kind == "phrase":
                words.update(rest[0][:-1] if rest[1] else rest[0])
            elif kind in ("and", "or"):
                left += rest[0]
            elif kind in ("not", "in"):
                left.append(rest[0] if kind == "not" else rest[1])
        return sorted(words)

    def __bool__(self) -> bool:
        return self.tree is not None


class _Malformed(Exception):
    pass


_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r'"([^"]*)"(\*)?|([()])|([^\s()"]+)')


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Parser:
    """Recursive descent: OR binds least, then AND, then NOT, and parts that only stand side by side bind most."""

    DEEPEST = 100

    def __init__(self, text: str):
        if text.count('"') % 2 or "^" in text:
            raise _Malformed
        self.pieces = [(m[0], m[1]) for m in _PIECE.finditer(text)]
        self.at = self.depth = 0

    def next(self) -> str | None:
        return self.pieces[self.at][0] if self.at < len(self.pieces) else None

    def chain(self, word: str, kind: str, part) -> Tree | None:
        found = [part()]
        while self.next() == word:
            self.at += 1
            found.append(part())
        found = [x for x in found if x]
        return (kind, found) if len(found) > 1 else found[0] if found else None

    def either(self) -> Tree | None:
        self.depth += 1
        if self.depth > self.DEEPEST:
            raise _Malformed
        out = self.chain("OR", "or", lambda: self.chain("AND", "and", self.without))
        self.depth -= 1
        return out

    def without(self) -> Tree | None:
        out = self.beside()
        while self.next() == "NOT":
            self.at += 1
            no = self.beside()
            out = ("not", out, no) if out and no else out
        return out

    def beside(self) -> Tree | None:
        found, some = [], False
        while (piece := self.next()) is not None and piece not in ("OR", "AND", "NOT", ")"):
            some = True
            if part := self.primary():
                found.append(part)
        if not some:
            raise _Malformed
        return ("and", found) if len(found) > 1 else found[0] if found else None

    def primary(self) -> Tree | None:
        piece, quoted = self.pieces[self.at]
        self.at += 1
        if piece == "(":
            inside = self.either()
            if self.next() != ")":
                raise _Malformed
            self.at += 1
            return inside
        if quoted is not None:
            return self.leaf(words_of(quoted), piece.endswith("*"))
        if m := re.fullmatch(r"(\w+):(.*)", piece):
            if m[2]:
                inside = self.leaf(words_of(m[2]), m[2].endswith("*"))
            elif self.next() in (None, "OR", "AND", "NOT", ")"):
                raise _Malformed
            else:
                inside = self.primary()
            return ("in", m[1], inside) if inside else None
        return self.leaf(words_of(piece), piece.endswith("*"))

    def leaf(self, words: list[str], prefix: bool) -> Tree | None:
        if len(words) > 1:
            return ("phrase", words, prefix)
        return ("prefix" if prefix else "word", words[0]) if words else None

    def whole(self) -> Tree | None:
        if not self.pieces:
            return None
        out = self.either()
        if self.next() is not None:
            raise _Malformed
        return out


def parse_query(text: str, columns: list[str] | None = None) -> Query:
    """Words side by side (all must occur), ``a AND b``, ``a OR b``, ``a NOT b``, parentheses, ``"a phrase"``, ``pre*`` and ``column:word``.

    What doesn't follow this syntax, or names a column that isn't among
    ``columns``, is taken as one phrase rather than refused; a query without any
    word is empty.
    """
    try:
        tree = _Parser(text).whole()
        if columns_of(tree) - set(columns or ()):
            raise _Malformed
        return Query(tree)
    except _Malformed:
        words = words_of(text)
        return Query(("phrase", words, False) if len(words) > 1 else ("word", words[0]) if words else None)


def columns_of(tree: Tree | None) -> set[str]:
    """The columns that an expression names."""
    found, left = set(), [tree] if tree else []
    while left:
        kind, *rest = left.pop()
        if kind == "in":
            found.add(rest[0])
            left.append(rest[1])
        elif kind in ("and", "or"):
            left += rest[0]
        elif kind == "not":
            left += rest
    return found


def patterns_of(tree: Tree | None) -> tuple[list[str], list[str]]:
    """The words and the prefixes that an expression looks for, wherever they stand in it."""
    words, prefixes, left = set(), set(), [tree] if tree else []
    while left:
        kind, *rest = left.pop()
        if kind == "word":
            words.add(rest[0])
        elif kind == "prefix":
            prefixes.add(rest[0])
        elif kind == "phrase":
            words.update(rest[0][:-1])
            (prefixes if rest[1] else words).add(rest[0][-1])
        elif kind in ("and", "or"):
            left += rest[0]
        else:
            left += rest[1:] if kind == "in" else rest
    return sorted(words), sorted(prefixes)


def bm25_part(tf: Column, length: Column, df: int, n: int, mean: float) -> Column:
    """What one term adds to a document's BM25."""
    idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(max(mean, 1e-9)))))


def postings(docs: DataFrame, id_col: str, text_cols: list[str], wanted: DataFrame | None = None, folded: bool = False) -> DataFrame:
    """The inverted index: (term, id, tf, length), one row per term and document; of the ``wanted`` terms (term) alone, if given."""
    text = F.concat_ws(" ", *text_cols)
    words = docs.select(F.col(id_col).alias("id"), tokens(text, folded).alias("words")).filter(F.size("words") > 0)
    listed = words.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
    if wanted is not None:
        listed = listed.join(wanted.select("term").distinct(), "term", "left_semi")
    return listed.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def lengths(docs: DataFrame, text_cols: list[str], folded: bool = False) -> tuple[int, float]:
    """How many documents have words, and their mean number of words: one scan, nothing exploded."""
    n = F.size(tokens(F.concat_ws(" ", *text_cols), folded))
    row = docs.select(n.alias("n")).filter("n > 0").agg(F.count("*"), F.avg("n")).first()
    return row[0], row[1] or 1.0


def _equals(term: str):
    return lambda w: w == F.lit(term)


def _starts(prefix: str):
    return lambda w: w.startswith(prefix)


def _matches(words: Column, tree: Tree, named: dict[str, Column]) -> Column:
    """Whether a token array satisfies an expression; ``named`` has the token arrays of single columns."""
    kind, *rest = tree
    if kind == "word":
        return F.array_contains(words, rest[0])
    if kind == "prefix":
        return F.exists(words, _starts(rest[0]))
    if kind == "phrase":
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return joined.contains(f" {' '.join(rest[0])}" + ("" if rest[1] else " "))
    if kind == "in":
        return _matches(named[rest[0]], rest[1], named)
    if kind == "not":
        return _matches(words, rest[0], named) & ~_matches(words, rest[1], named)
    parts = [_matches(words, t, named) for t in rest[0]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if kind == "and" else out | p
    return out


def search(docs: DataFrame, query: Query | str, id_col: str, text_cols: list[str], folded: bool = False) -> DataFrame:
    """(id, rank) of the documents that match; rank is minus BM25, so lower is better.

    One scan: each document is matched and its term counts taken where it is
    read, from tokens that are made once; only a handful of totals (documents,
    words, documents per term) is aggregated over all.  No index, shuffle or
    join by term is needed for one query; :func:`search_many` is the form for
    many.  ``folded`` compares without diacritics.
    """
    query = parse_query(query, text_cols) if isinstance(query, str) else query
    if not query:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("rank")).limit(0)
    scored, used = query.scored(), sorted(columns_of(query.tree))
    arrays = F.struct(tokens(F.concat_ws(" ", *text_cols), folded).alias("all"), *(tokens(F.col(c), folded).alias(f"in_{c}") for c in used))

    def measured(w: Column) -> Column:
        words = w["all"]
        counts = (F.size(F.filter(words, _equals(t))).alias(f"tf{i}") for i, t in enumerate(scored))
        return F.struct(F.size(words).alias("length"), _matches(words, query.tree, {c: w[f"in_{c}"] for c in used}).alias("hit"), *counts)

    # a one-element array binds the tokens to a name, so that they are made once
    counted = docs.select(F.col(id_col).alias("id"), F.transform(F.array(arrays), measured)[0].alias("m"))
    some = F.col("m.length") > 0
    totals = counted.agg(F.count_if(some).alias("n"), F.sum(F.col("m.length").cast("long")).alias("words"), *(F.count_if(F.col(f"m.tf{i}") > 0).alias(f"df{i}") for i in range(len(scored))))
    row = totals.first()
    n, mean = row["n"], (row["words"] or 0) / max(row["n"], 1)
    score = F.lit(0.0)
    for i in range(len(scored)):
        score = score + bm25_part(F.col(f"m.tf{i}"), F.col("m.length"), row[f"df{i}"], n, mean)
    return counted.filter(F.col("m.hit") & some).select("id", F.round(-score, 6).alias("rank"))


def search_many(index: DataFrame, queries: DataFrame, n_docs: int, mean_length: float) -> DataFrame:
    """Ranks for many word queries at once: index of :func:`postings`, queries (query_id, term) all of which must occur.

    A query's rarest term gives its candidates; only those are held against its
    other terms, by an equi-join on term and document.
    """
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    wanted = queries.distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("terms"))
    known = wanted.join(df, "term")
    rarest = known.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("found")).join(sizes, "query_id").filter("found = terms")
    candidates = rarest.select("query_id", "term", "terms").join(index.select("term", "id"), "term").select("query_id", "id", "terms")
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    hits = candidates.join(known, "query_id").join(index, ["term", "id"]).groupBy("query_id", "id").agg(F.first("terms").alias("terms"), F.count("*").alias("found"), F.sum(part).alias("score"))
    return hits.filter("found = terms").select("query_id", "id", (-F.col("score")).alias("rank"))


def snippet(text: Column, terms: list[str], width: int = 10, before: str = "<b>", after: str = "</b>", ellipsis: str = "...") -> Column:
    """The ``width`` words with the most hits (the first such run), hits marked."""
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    wanted = F.array(*map(F.lit, terms))
    plain = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    marked = F.transform(words, lambda w: F.struct(w.alias("w"), F.array_contains(wanted, plain(w)).alias("hit")))

    def of(rows: Column) -> Column:
        last = F.greatest(F.size(rows) - width, F.lit(0))
        # starting at a hit is enough; a run's hits are counted inside it
        starts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((-F.size(F.filter(F.slice(rows, i + 1, width), lambda x: x["hit"]))).alias("less"), i.alias("i")))
        best = F.array_min(starts)["i"]
        body = F.array_join(F.transform(F.slice(rows, best + 1, width), lambda x: F.when(x["hit"], F.concat(F.lit(before), x["w"], F.lit(after))).otherwise(x["w"])), " ")
        return F.concat(F.when(best > 0, ellipsis).otherwise(""), body, F.when(best < last, ellipsis).otherwise(""))

    return F.transform(F.array(marked), of)[0]


def with_fallback(hits: DataFrame, names: DataFrame, query: str, id_col: str, name_col: str) -> DataFrame:
    """Search hits, or, where there are none, rows of exactly that name with rank 1."""
    exact = names.filter(F.col(name_col) == query).select(F.col(id_col).alias("id"), F.lit(1.0).alias("rank"))
    if hits.isEmpty():
        return exact
    return hits.select("id", "rank")


def loose_hits(rows: DataFrame, query: str, id_col: str, name_col: str) -> DataFrame:
    """Rows whose name contains the query: rank 2 for the very name, 5 otherwise."""
    return rows.filter(F.col(name_col).ilike(f"%{query}%")).select(F.col(id_col).alias("id"), F.when(F.col(name_col) == query, 2.0).otherwise(5.0).alias("rank"))


def bucketed(rows: DataFrame, query: str, name_col: str) -> DataFrame:
    """Rows whose name is like the query, with bucket 0 for the very name, 1 for a beginning, 2 otherwise.

    ``%`` and ``_`` in the query stay wildcards, and case is ignored.
    """
    bucket = F.when(F.lower(name_col) == query.lower(), 0).when(F.col(name_col).ilike(f"{query}%"), 1).otherwise(2)
    return rows.filter(F.col(name_col).ilike(f"%{query}%")).withColumn("bucket", bucket)
