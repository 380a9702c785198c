"""Which owners have all elements of a set: interfaces that a type satisfies, orders that a stock covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements of a set that are looked up one after the other, from the rarest, before the rest are counted.
PREFIX = 3


def contained_sets(sets: DataFrame, owners: DataFrame, set_id: str, owner_id: str, element: str, prefix: int = PREFIX) -> DataFrame:
    """(owner, set) pairs in which the owner has every element of the set; a set has one at least.

    Each set is stored under its rarest element, so a pair is only made where the
    owner has that one.  The next rarest elements then drop pairs one by one, by
    semi-joins on (owner, element); those that are left are held against all
    other elements by counting.  Elements that no owner has rule out their set
    before any pair is made; null ids and elements are no members.
    """
    members = sets.select(F.col(set_id).alias("set"), F.col(element).alias("_e")).dropna().distinct()
    have = owners.select(F.col(owner_id).alias("owner"), F.col(element).alias("_e")).dropna().distinct()
    frequency = have.groupBy("_e").agg(F.count("*").alias("_df"))
    counted = members.join(frequency, "_e", "left")
    possible = counted.groupBy("set").agg(F.count("*").alias("_size"), F.count("_df").alias("_known")).filter("_size = _known").drop("_known")
    rank = F.row_number().over(Window.partitionBy("set").orderBy("_df", "_e"))
    ranked = counted.join(possible, "set").withColumn("_rank", rank)
    pairs = ranked.filter("_rank = 1").join(have, "_e").select("owner", "set", "_size")
    for k in range(2, prefix + 1):
        held = pairs.filter(F.col("_size") >= k).join(ranked.filter(F.col("_rank") == k).select("set", "_e"), "set").join(have, ["owner", "_e"], "left_semi").drop("_e")
        pairs = pairs.filter(F.col("_size") < k).unionByName(held.select("owner", "set", "_size"))
    rest = ranked.filter(F.col("_rank") > prefix).select("set", "_e")
    whole = pairs.filter(F.col("_size") > prefix).join(rest, "set").join(have, ["owner", "_e"], "left_semi").groupBy("owner", "set").agg(F.first("_size").alias("_size"), F.count("*").alias("_n"))
    return pairs.filter(F.col("_size") <= prefix).select("owner", "set").unionByName(whole.filter(F.col("_n") == F.col("_size") - prefix).select("owner", "set"))
