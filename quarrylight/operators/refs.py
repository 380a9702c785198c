"""References to symbols, callers and callees, in bulk: for all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a part in :func:`pairs_by_name`, and the most tasks that its cells are dealt to.
CELL_ROWS, MOST_TASKS = 3500, 4096


def referencers(
    references: DataFrame,
    symbols: DataFrame,
    ref_id: str,
    target: str,
    name: str,
    candidates: str | None,
    symbol_id: str,
    symbol_name: str,
    extra: list[str] | None = None,
) -> DataFrame:
    """(reference, symbol) pairs: the target is the symbol, or there is no target
    and the names agree, or the symbol is among the candidates.

    A join on that OR would compare all pairs; it is three equi-joins whose
    union is made distinct, so a reference that two branches reach counts once.
    """
    keep = [ref_id, *(extra or [])]
    syms = symbols.select(F.col(symbol_id).alias("symbol_id"), F.col(symbol_name).alias("_name"))
    direct = references.select(*keep, F.col(target).alias("symbol_id")).join(syms.select("symbol_id"), "symbol_id", "left_semi")
    by_name = references.filter(F.col(target).isNull()).select(*keep, F.col(name).alias("_name")).join(syms, "_name").select(*keep, "symbol_id")
    out = direct.select(*keep, "symbol_id").unionByName(by_name)
    if candidates:
        listed = references.select(*keep, F.explode(candidates).alias("symbol_id")).join(syms.select("symbol_id"), "symbol_id", "left_semi")
        out = out.unionByName(listed.select(*keep, "symbol_id"))
    return out.dropDuplicates([ref_id, "symbol_id"])


def referencers_of_sets(references: DataFrame, sets: DataFrame, symbols: DataFrame, ref_id: str, target: str, name: str, symbol_id: str, symbol_name: str, extra: list[str] | None = None) -> DataFrame:
    """As :func:`referencers`, where references hold the ``set_id`` of their candidates and ``sets`` (set_id, candidate) what these are.

    The sets that hold an asked symbol are found first, then their references;
    sets that hold none are read once and expanded never.
    """
    keep = [ref_id, *(extra or [])]
    syms = symbols.select(F.col(symbol_id).alias("symbol_id"), F.col(symbol_name).alias("_name"))
    direct = references.select(*keep, F.col(target).alias("symbol_id")).join(syms.select("symbol_id"), "symbol_id", "left_semi").select(*keep, "symbol_id")
    by_name = references.filter(F.col(target).isNull()).select(*keep, F.col(name).alias("_name")).join(syms, "_name").select(*keep, "symbol_id")
    holding = sets.select("set_id", F.col("candidate").alias("symbol_id")).join(syms.select("symbol_id"), "symbol_id", "left_semi")
    listed = references.select(*keep, "set_id").join(holding, "set_id").select(*keep, "symbol_id")
    return direct.unionByName(by_name).unionByName(listed).dropDuplicates([ref_id, "symbol_id"])


def callers(calls: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct (target, caller) pairs."""
    return calls.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(target).alias("symbol_id"), F.col(source).alias("caller_id")).distinct()


def callees(calls: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct (source, callee) pairs."""
    return calls.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("symbol_id"), F.col(target).alias("callee_id")).distinct()


def pairs_by_name(left: DataFrame, right: DataFrame, links: DataFrame, owner: str, name: str, member_id: str) -> DataFrame:
    """(derived member, base member) of the same name for each (derived, base) link: the override pairs.

    The members of a name on either side are dealt to parts of CELL_ROWS, and
    part meets part in a cell of its own, so neither a common name nor a few
    small inputs put many pairs into one task.
    """
    d = left.select(F.col(owner).alias("derived"), F.col(name).alias("name"), F.col(member_id).alias("derived_member"))
    b = right.select(F.col(owner).alias("base"), F.col(name).alias("name"), F.col(member_id).alias("base_member"))
    counted = lambda df, key, n: df.groupBy(key, "name").agg(F.count("*").alias(n))
    sizes = links.select("derived", "base").distinct().join(counted(d, "derived", "_d"), "derived").join(counted(b, "base", "_b"), ["base", "name"])
    parts = lambda n: F.ceil(F.col(n) / CELL_ROWS).cast("int")
    cells = sizes.select("derived", "base", "name", parts("_d").alias("_ds"), parts("_b").alias("_bs"))
    part = lambda member, n: F.pmod(F.xxhash64(member), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["derived", "base", "name", "_i", "_j"]
    ds = d.join(cells, ["derived", "name"]).withColumn("_i", part("derived_member", "_ds")).withColumn("_j", every("_bs")).select(*key, "derived_member")
    bs = b.join(cells, ["base", "name"]).withColumn("_j", part("base_member", "_bs")).withColumn("_i", every("_ds")).select(*key, "base_member")
    pairs = sizes.agg(F.sum(F.col("_d").cast("double") * F.col("_b"))).first()[0] or 0
    tasks = min(int(pairs // CELL_ROWS**2) + 1, MOST_TASKS)
    if tasks > 1:  # by bytes, which adaptive execution goes by, the inputs would often be one task
        ds, bs = ds.repartition(tasks, *key), bs.repartition(tasks, *key)
    return ds.join(bs, key).select("derived", "base", "name", "derived_member", "base_member")
