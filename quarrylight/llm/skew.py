"""Joins of many rows with a table of keys, of which a few may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one part in PARTS of all rows is dealt over salts, a part to each; there are fewer such keys than PARTS.
PARTS = 1000
#: Keys of so few rows are never dealt out.
SMALL = 256


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """Join on the keys of rows with ``table``, one row per key, whose column ``size`` tells about how many rows a key has.

    ``total`` is the sum of the sizes, or more.  The rows of a hot key are dealt
    by ``spread`` over as many salts as its size asks for, and its row of the
    table is repeated for each, so no key's rows meet in one task.  Only the list
    of hot keys is broadcast; by its definition it has fewer than PARTS rows.
    """
    part = max(total // PARTS, SMALL)
    salts = F.ceil(F.col(size) / part).cast("int")
    hot = table.filter(F.col(size) > part).select(*keys, salts.alias("_salts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
