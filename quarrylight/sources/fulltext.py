"""A stored full-text index: postings in immutable segments, dealt to folders by the hash of the term.

A commit tokenises the documents it is given and nothing else: it writes one
segment with their postings and lengths, and deletion marks for what earlier
segments have of them and of removed documents.  Segments are merged as they
grow (see :mod:`quarrylight.sources.layers`).  A search reads the folders of its
terms, as the scan's partition filters show; a prefix, which has no one hash, is
pushed into the scan of all folders, whose files are sorted by term.  Numbers of
documents and words are kept in the manifest, so no search scans for them.

Ranks and the syntax of queries are those of
:func:`quarrylight.operators.search.search`, which reads the texts themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.text import tokens
from quarrylight.operators.graph import holding
from quarrylight.operators.search import Query, Tree, bm25_part, columns_of, parse_query, patterns_of
from quarrylight.sources.layers import Layers
from quarrylight.sources.manifest import Manifests

POSTINGS = "term string, id bigint, tf int, length int, places array<int>"
DOCUMENTS = "id bigint, length int, ends array<int>"


#: Postings of an Arrow batch.
BATCH = 100_000


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) to the postings of each document, made where it is read, one document at a time."""
    for batch in batches:
        ids, words = batch.columns
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            places: dict[str, list[int]] = {}
            own = words[i].as_py()
            for at, word in enumerate(own):
                places.setdefault(word, []).append(at)
            id_, length = ids[i].as_py(), len(own)
            del own
            rows += ((term, id_, len(at), length, at) for term, at in places.items())
            while len(rows) >= BATCH:
                yield _batch(rows[:BATCH])
                del rows[:BATCH]
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"term": pa.string(), "id": pa.int64(), "tf": pa.int32(), "length": pa.int32(), "places": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


class TextIndex:
    """An index of documents with a bigint id and some text columns below a root."""

    def __init__(self, spark: SparkSession, root: str, columns: list[str], folded: bool = False):
        self.spark, self.root, self.columns, self.folded = spark, root.rstrip("/"), columns, folded
        self.manifests = Manifests(spark, self.root)
        self.postings = Layers(self.manifests, self.root, POSTINGS, "id", by="term", order=["term", "id"])
        self.documents = Layers(self.manifests, self.root, DOCUMENTS, "id")

    def state(self, version: int | None = None) -> dict:
        """What a version consists of: segments, documents with words, words, and the caller's note."""
        return {"postings": [], "documents": [], "n": 0, "words": 0, "note": None} | self.manifests.read(version)

    def commit(self, docs: DataFrame, id_col: str, removed: DataFrame | None = None, note=None, base: int | None = None) -> int:
        """A version in which ``docs`` have taken the place of what it had by their ids, and ``removed`` (id) are gone."""
        base = self.manifests.version() if base is None else base
        state, at = self.state(base), f"segments/{base + 1}-{uuid.uuid4().hex}"
        with holding() as keep:
            split = docs.select(F.col(id_col).cast("long").alias("id"), *(tokens(F.col(c), self.folded).alias(f"in_{c}") for c in self.columns))
            inside = [F.col(f"in_{c}") for c in self.columns]
            source = split.select("id", F.concat(*inside).alias("words"), F.array(*(F.size(x) for x in inside)).alias("sizes"))
            ends = F.transform("sizes", lambda _, i: F.aggregate(F.slice("sizes", 1, i + 1), F.lit(0), lambda a, x: a + x))
            # only numbers are kept: words and postings, many times as large, are made where they are written
            measured = keep(source.select("id", F.size("words").alias("length"), ends.alias("ends"), F.size(F.array_distinct("words")).alias("terms")))
            fresh = measured.select("id", "length", "ends").filter("length > 0")
            posted = source.select("id", "words").mapInArrow(_posted, POSTINGS)
            gone, n, total = None, state["n"], state["words"]
            if state["documents"]:
                own = measured.select("id")
                gone = keep((own if removed is None else own.unionByName(removed.select(F.col(removed.columns[0]).cast("long").alias("id")))).distinct())
                old = self.documents.visible(state["documents"]).join(gone, "id", "left_semi").agg(F.count("*"), F.sum(F.col("length").cast("long"))).first()
                n, total = n - old[0], total - (old[1] or 0)
            new = measured.filter("length > 0").agg(F.count("*"), F.sum(F.col("length").cast("long")), F.sum(F.col("terms").cast("long"))).first()
            after = {"n": n + new[0], "words": total + (new[1] or 0), "note": note}
            for name, layers, rows, size in (("postings", self.postings, posted, new[2] or 0), ("documents", self.documents, fresh, new[0])):
                segments = [*state[name], layers.write(rows, f"{at}/{name}", base + 1, gone, size)]
                after[name] = layers.merged(segments, f"{at}/{name}-merged")
        return self.manifests.publish(after, base + 1)

    def found(self, terms: list[str], prefixes: list[str] = (), version: int | None = None, state: dict | None = None) -> DataFrame:
        """The visible postings of some terms, and of terms that begin with some prefixes."""
        layers = (state or self.state(version))["postings"]
        exact = self.postings.visible(layers, sorted(terms)) if terms else None
        if not prefixes:
            return exact if exact is not None else self.postings.visible([])
        begins = lambda rows, _: rows.filter(_any([F.col("term").startswith(p) for p in prefixes]))
        others = self.postings.visible(layers, None, begins)
        if exact is None:
            return others
        return exact.unionByName(others.filter(~F.col("term").isin(sorted(terms))))

    def search(self, query: Query | str, version: int | None = None) -> DataFrame:
        """(id, rank) of the documents that match; rank is minus BM25."""
        return search([self], query, [self.state(version)])

    def many(self, asked: DataFrame, version: int | None = None) -> tuple[DataFrame, int, float]:
        """The postings of the ``asked`` terms (term), the number of documents and their mean length, as ``search.search_many`` takes them."""
        state = self.state(version)
        terms = asked.select("term").distinct()
        rows = self.postings.visible(state["postings"], None, lambda rows, _: rows.join(terms, "term", "left_semi"))
        return rows.select("term", "id", "tf", "length"), state["n"], state["words"] / state["n"] if state["n"] else 1.0


def search(indexes: list[TextIndex], query: Query | str, states: list[dict] | None = None) -> DataFrame:
    """(id, rank) over the documents of one or several indexes of the same columns, as if they were one."""
    first = indexes[0]
    query = parse_query(query, first.columns) if isinstance(query, str) else query
    states = states or [x.state() for x in indexes]
    n, total = sum(s["n"] for s in states), sum(s["words"] for s in states)
    if not query or not n:
        return first.spark.createDataFrame([], "id bigint, rank double")
    words, prefixes = patterns_of(query.tree)
    rows, ends = None, None
    for index, state in zip(indexes, states, strict=True):
        found, known = index.found(words, prefixes, state=state), index.documents.visible(state["documents"]).select("id", "ends")
        rows, ends = (found, known) if rows is None else (rows.unionByName(found), ends.unionByName(known))
    scored = query.scored()
    frequency = {r["term"]: r["df"] for r in rows.filter(F.col("term").isin(scored)).groupBy("term").agg(F.count("*").alias("df")).collect()} if scored else {}
    by_doc = rows.groupBy("id").agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    if columns_of(query.tree):
        by_doc = by_doc.join(ends, "id")
    matching = by_doc.filter(_matches(query.tree, None, {c: i for i, c in enumerate(first.columns)}))
    score = F.lit(0.0)
    for term in scored:
        tf = F.coalesce(F.size(F.try_element_at("at", F.lit(term))), F.lit(0))
        score = score + bm25_part(tf, F.col("length"), frequency.get(term, 0), n, total / n)
    return matching.select("id", F.round(-score, 6).alias("rank"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _places(tree: Tree, column: int | None) -> Column:
    """Where a word, or any word of a prefix, stands in the document (within one column, if given)."""
    kind, text = tree
    if kind == "word":
        places = F.coalesce(F.try_element_at("at", F.lit(text)), F.array().cast("array<int>"))
    else:
        places = F.flatten(F.map_values(F.map_filter("at", lambda k, _: k.startswith(text))))
    if column is None:
        return places
    lo = F.lit(0) if not column else F.col("ends")[column - 1]
    return F.filter(places, lambda p: (p >= lo) & (p < F.col("ends")[column]))


def _matches(tree: Tree, column: int | None, numbers: dict[str, int]) -> Column:
    """Whether a document satisfies an expression, by the places of its terms."""
    kind, *rest = tree
    if kind in ("word", "prefix"):
        return F.size(_places(tree, column)) > 0
    if kind == "phrase":
        words, open_ended = rest
        parts = [_places(("word", w), column) for w in words[:-1]] + [_places(("prefix" if open_ended else "word", words[-1]), column)]

        def follows(start: Column) -> Column:
            out = F.lit(True)
            for i, places in enumerate(parts[1:], 1):
                out = out & F.array_contains(places, start + i)
            return out

        return F.exists(parts[0], follows)
    if kind == "in":
        return _matches(rest[1], numbers[rest[0]], numbers)
    if kind == "not":
        return _matches(rest[0], column, numbers) & ~_matches(rest[1], column, numbers)
    tests = [_matches(t, column, numbers) for t in rest[0]]
    if kind == "or":
        return _any(tests)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out
