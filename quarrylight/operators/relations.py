"""The relation graph of a code base, from its symbols, references and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import arity
from quarrylight.operators import dedupe, intervals
from quarrylight.operators.containment import contained_sets
from quarrylight.operators.resolve import candidate_sets

_COLUMNS = ["workspace_id", "source_symbol_id", "target_symbol_id", "set_id", "kind", "target_name", "confidence"]


def contains(symbols: DataFrame) -> DataFrame:
    """Parent to child: by the scope, else by the smallest body around the name in the file."""
    named = symbols.filter("scope_symbol_id is not null")
    by_scope = named.select("workspace_id", F.col("scope_symbol_id").alias("source_symbol_id"), F.col("id").alias("target_symbol_id"), F.col("name").alias("target_name"), F.lit(1.0).alias("confidence"))
    rest = symbols.filter("scope_symbol_id is null and kind <> 'module'")
    inner = rest.select("workspace_id", "file_id", "id", "name", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    outer = symbols.select("file_id", F.col("id").alias("outer"), F.col("body_start").alias("start"), F.col("body_end").alias("end"), F.col("start_byte").alias("at"))
    # a symbol's own body holds its name: only bodies that start before it count
    held = intervals.smallest_enclosing(inner, outer.filter("start < at or end > at"), ["file_id"], "id", "outer").filter("id <> outer")
    by_range = inner.join(held, ["file_id", "id"]).select("workspace_id", F.col("outer").alias("source_symbol_id"), F.col("id").alias("target_symbol_id"), F.col("name").alias("target_name"), F.lit(0.8).alias("confidence"))
    return _single(by_scope.unionByName(by_range).withColumn("kind", F.lit("contains")))


def calls(references: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Caller to target, and (set_id, candidate) of sets of targets that no resolution had.

    A call with several candidates is one edge to their set; one without any is an
    edge to the set of callables of its name, else an edge without target.  Sets
    are expanded by :func:`expanded`, where edges are read.
    """
    made = references.filter(F.col("kind").isin("call", "invocation") & F.col("source_symbol_id").isNotNull()).select("workspace_id", "source_symbol_id", "target_symbol_id", "set_id", F.col("name").alias("target_name"), "confidence")
    callable_ = symbols.filter(F.col("kind").isin("function", "method", "class", "macro")).select("workspace_id", F.col("name").alias("target_name"), "id")
    named, sets = candidate_sets(callable_, ["workspace_id", "target_name"], "id")
    lost = F.col("target_symbol_id").isNull() & F.col("set_id").isNull()
    known = made.filter(~lost).withColumn("target_symbol_id", F.when(F.col("set_id").isNull(), F.col("target_symbol_id")))
    by_name = made.filter(lost).drop("set_id").join(named.select("workspace_id", "target_name", "set_id"), ["workspace_id", "target_name"], "left")
    edges = known.unionByName(by_name.select(*known.columns)).withColumn("kind", F.lit("calls")).select(*_COLUMNS)
    return edges, sets.join(by_name.select("set_id").distinct(), "set_id", "left_semi")


def expanded(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges with one target each: an edge to a set becomes one to each of its members."""
    single, several = edges.filter("set_id is null"), edges.filter("set_id is not null")
    members = several.drop("target_symbol_id").join(sets.select("set_id", F.col("candidate").alias("target_symbol_id")).distinct(), "set_id")
    return single.unionByName(members.select(*edges.columns)).drop("set_id")


def inherits(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Derived to base, from inheritance and implementation occurrences whose scope is the derived class."""
    kinds = {"inheritance": "inherits", "implementation": "implements"}
    made = occurrences.filter(F.col("kind").isin(*kinds)).select("workspace_id", "file_id", F.col("scope").alias("qualified_name"), F.col("name").alias("target_name"), F.col("symbol_id").alias("target_symbol_id"), "confidence", F.when(F.col("kind") == "inheritance", "inherits").otherwise("implements").alias("kind"))
    own = symbols.groupBy("file_id", "qualified_name").agg(F.min("id").alias("source_symbol_id"))
    return _single(made.join(own, ["file_id", "qualified_name"]))


def overrides(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Method to the method of the same name in a direct base."""
    methods = symbols.filter("kind in ('method', 'function') and scope_symbol_id is not null").select("workspace_id", "id", "name", "scope_symbol_id")
    links = edges.filter("kind in ('inherits', 'implements') and target_symbol_id is not null").select(F.col("source_symbol_id").alias("_d"), F.col("target_symbol_id").alias("_b")).distinct()
    derived = methods.select("workspace_id", F.col("scope_symbol_id").alias("_d"), "name", F.col("id").alias("source_symbol_id"))
    bases = methods.select(F.col("scope_symbol_id").alias("_b"), "name", F.col("id").alias("target_symbol_id"))
    pairs = links.join(derived, "_d").join(bases, ["_b", "name"])
    return _single(pairs.select("workspace_id", "source_symbol_id", "target_symbol_id", F.lit("overrides").alias("kind"), F.col("name").alias("target_name"), F.lit(0.9).alias("confidence")))


def imports(dependencies: DataFrame, symbols: DataFrame) -> DataFrame:
    """The importing file's first symbol to the imported file's, with the name as written."""
    first = symbols.groupBy("file_id").agg(F.min_by("id", F.struct("start_byte", "id")).alias("_first"))
    source = first.select(F.col("file_id").alias("source_file_id"), F.col("_first").alias("source_symbol_id"))
    target = first.select(F.col("file_id").alias("target_file_id"), F.col("_first").alias("target_symbol_id"))
    rows = dependencies.join(source, "source_file_id").join(target, "target_file_id", "left")
    kind = F.when(F.col("kind") == "include", "includes").otherwise("imports")
    return _single(rows.select("workspace_id", "source_symbol_id", "target_symbol_id", kind.alias("kind"), F.col("raw_name").alias("target_name"), "confidence"))


def satisfied(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Go's types to the interfaces whose methods they all have, embedded interfaces left aside; by :func:`contained_sets` on names and numbers of parameters."""
    there = files.filter("language = 'go'").select("file_id")
    if not there.limit(1).count():
        return _single(symbols.limit(0).select("workspace_id", F.col("id").alias("source_symbol_id"), F.col("id").alias("target_symbol_id"), F.lit("implements").alias("kind"), F.col("name").alias("target_name"), F.lit(0.9).alias("confidence")))
    go = symbols.join(there, "file_id", "left_semi")
    owners = go.filter("kind in ('interface', 'struct', 'class', 'type_alias')").select("workspace_id", F.col("id").alias("owner"), F.col("kind").alias("owner_kind"), F.col("qualified_name").alias("scope"), "name")
    methods = go.filter("kind = 'method'").select("workspace_id", "scope", F.concat_ws("/", "name", arity(F.col("signature")).cast("string")).alias("method"))
    held = methods.join(owners, ["workspace_id", "scope"]).withColumn("element", F.concat_ws(":", "workspace_id", "method"))
    pairs = contained_sets(held.filter("owner_kind = 'interface'"), held.filter("owner_kind <> 'interface'"), "owner", "owner", "element")
    named = owners.select(F.col("owner").alias("set"), "workspace_id", F.col("name").alias("target_name"))
    return _single(pairs.join(named, "set").select("workspace_id", F.col("owner").alias("source_symbol_id"), F.col("set").alias("target_symbol_id"), F.lit("implements").alias("kind"), "target_name", F.lit(0.9).alias("confidence")))


def _single(edges: DataFrame) -> DataFrame:
    return edges.withColumn("set_id", F.lit(None).cast("bigint")).select(*_COLUMNS)


def build(symbols: DataFrame, occurrences: DataFrame, references: DataFrame, dependencies: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All relations, of equal edges the most certain, and the sets that calls by name lead to."""
    based = inherits(occurrences, symbols).unionByName(satisfied(symbols, files))
    called, sets = calls(references, symbols)
    every = contains(symbols).unionByName(called).unionByName(based).unionByName(overrides(symbols, based)).unionByName(imports(dependencies, symbols))
    keyed = every.withColumns({"_target": F.coalesce("target_symbol_id", F.lit(0)), "_set": F.coalesce("set_id", F.lit(0)), "_name": F.coalesce("target_name", F.lit("")), "_less": -F.col("confidence")})
    return dedupe.first_by(keyed, ["source_symbol_id", "_target", "_set", "kind", "_name"], ["_less"]).select(*_COLUMNS), sets
