"""What one workspace sees of the others: itself and those it links to, not theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visibility(owners: DataFrame, owner: str, links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(viewer, owner) pairs: each owner itself, and the direct targets of its links."""
    own = owners.select(F.col(owner).alias("viewer"), F.col(owner).alias("owner")).distinct()
    return own.unionByName(links.select(F.col(source).alias("viewer"), F.col(target).alias("owner"))).filter("viewer is not null and owner is not null").distinct()


def visible(rows: DataFrame, owner: str, pairs: DataFrame) -> DataFrame:
    """Rows beside each viewer that sees them."""
    return rows.join(pairs.select("viewer", F.col("owner").alias(owner)), owner)


def redact(rows: DataFrame, viewer: str, target_owner: str, targets: list[str], state: str, pairs: DataFrame) -> DataFrame:
    """Rows stay; where the viewer doesn't see the target's owner, the target is nulled and the state unresolved."""
    seen = pairs.select(F.col("viewer").alias(viewer), F.col("owner").alias(target_owner), F.lit(True).alias("_seen"))
    joined = rows.join(seen, [viewer, target_owner], "left")
    hidden = F.col("_seen").isNull()
    return joined.withColumns({c: F.when(~hidden, F.col(c)) for c in targets} | {state: F.when(hidden, "unresolved").otherwise(F.col(state))}).select(*rows.columns)
