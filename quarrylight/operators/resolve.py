"""Resolution of names: tiers of candidates, of which the first that has any wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ["resolved", "ambiguous", "unresolved", "external"]
#: Languages that see each other's symbols.
COMPATIBLE = [("c", "cpp"), ("shell", "bash"), ("typescript", "javascript")]


def compatible(a: Column, b: Column) -> Column:
    ok = a == b
    for x, y in COMPATIBLE:
        ok = ok | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return ok


def candidate_tiers(tiers: list[tuple[str, float, DataFrame]], key: str, candidate: str) -> DataFrame:
    """(key, candidate) frames in order of preference to one frame with ``tier``, ``reason`` and ``confidence``."""
    out = None
    for i, (reason, confidence, df) in enumerate(tiers):
        part = df.select(F.col(key), F.col(candidate).alias("candidate"), F.lit(i).alias("tier"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def resolve(occurrences: DataFrame, key: str, candidates: DataFrame, prefer: str | None = None) -> DataFrame:
    """Per occurrence: state, target, confidence, reason, number of candidates and all of them.

    Only the first tier with any candidate counts.  One candidate resolves with
    the tier's confidence, several are ambiguous at 0.5 with the first as the
    target, none is unresolved at 0.  Two aggregations: the candidates are
    merged per (occurrence, tier) before the tiers are compared.  Edges and
    referencers are made from the saved candidates, so none is left out.
    """
    rank = F.struct(F.col(prefer) if prefer else F.lit(0), F.col("candidate"))
    distinct = candidates.groupBy(key, "tier", "candidate").agg(F.min(F.col(prefer) if prefer else F.lit(0)).alias(prefer or "_0"), F.first("reason").alias("reason"), F.first("confidence").alias("confidence"))
    per_tier = distinct.groupBy(key, "tier").agg(F.count("*").alias("n"), F.min(rank).alias("first"), F.first("reason").alias("reason"), F.first("confidence").alias("confidence"), F.sort_array(F.collect_list("candidate")).alias("all"))
    best = per_tier.groupBy(key).agg(F.min(F.struct("tier", "n", "first.candidate", "reason", "confidence", "all")).alias("b"))
    joined = occurrences.join(best, key, "left")
    n = F.coalesce(F.col("b.n"), F.lit(0))
    return joined.select(
        *occurrences.columns,
        F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("resolution"),
        F.col("b.candidate").alias("target"),
        F.when(n == 0, 0.0).when(n == 1, F.col("b.confidence")).otherwise(0.5).alias("confidence"),
        F.coalesce("b.reason", F.lit("none")).alias("reason"),
        n.cast("long").alias("n_candidates"),
        F.col("b.all").alias("candidates"),
    )


def resolve_tiers(occurrences: DataFrame, tiers: list[tuple[str, float, list[str], DataFrame]], candidate: str, prefer: str | None = None) -> DataFrame:
    """As :func:`resolve`, for tiers that are looked up by key columns.

    Each tier is (reason, confidence, key columns, candidates with those
    columns).  Candidates are merged per key before the join, so a tier adds one
    row per occurrence at most, however many candidates a common name has.
    """
    out = occurrences
    hits = []
    for i, (reason, confidence, keys, candidates) in enumerate(tiers):
        rank = F.struct(F.col(prefer) if prefer else F.lit(0), F.col(candidate))
        distinct = candidates.select(*keys, candidate, *([prefer] if prefer else [])).distinct()
        found = F.struct(
            F.count_distinct(candidate).alias("n"),
            F.min_by(candidate, rank).alias("candidate"),
            F.lit(reason).alias("reason"),
            F.lit(confidence).alias("confidence"),
            F.sort_array(F.collect_set(candidate)).alias("all"),
        )
        merged = distinct.groupBy(*keys).agg(found.alias(f"_t{i}"))
        out = out.join(merged, keys, "left")
        hits.append(F.col(f"_t{i}"))
    b = F.coalesce(*hits)
    n = F.coalesce(b["n"], F.lit(0))
    return out.select(
        *occurrences.columns,
        F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("resolution"),
        b["candidate"].alias("target"),
        F.when(n == 0, 0.0).when(n == 1, b["confidence"]).otherwise(0.5).alias("confidence"),
        F.coalesce(b["reason"], F.lit("none")).alias("reason"),
        n.cast("long").alias("n_candidates"),
        b["all"].alias("candidates"),
    )


def resolve_counted(occurrences: DataFrame, key: str, tiers: list[tuple[str, float, list[str], DataFrame, bool]], candidate: str) -> DataFrame:
    """As :func:`resolve_tiers`, for the number of candidates and the first one alone; a tier ends with whether an occurrence is left out of its own candidates.

    Candidates are counted where their keys have them, so occurrences that share
    many cost a row each and no pairs.  The few whose rows ask for several sets
    are counted over the union of these.
    """
    out, hits = occurrences, []
    for i, (reason, confidence, keys, candidates, others) in enumerate(tiers):
        members = candidates.select(*keys, F.col(candidate).alias("_c")).filter("_c is not null").distinct()
        first = members.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_c").alias("_first"))
        asked = occurrences.select(F.col(key).alias("_key"), *keys).filter("_key is not null").distinct()
        if others:
            second = members.join(first, keys).filter("_c > _first").groupBy(*keys).agg(F.min("_c").alias("_second"))
            own = members.withColumn("_key", F.col("_c")).withColumnRenamed("_c", "_own")
            left = asked.join(own, ["_key", *keys], "left").join(first, keys).join(second, keys, "left")
            found = left.select("_key", *keys, (F.col("_n") - F.col("_own").isNotNull().cast("long")).alias("_n"), F.when(F.col("_own") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("_first")).filter("_n > 0")
        else:
            found = asked.join(first, keys)
        every = found.groupBy("_key").agg(F.count("*").alias("_sets"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
        several = found.join(every.filter("_sets > 1").select("_key"), "_key", "left_semi").select("_key", *keys).join(members, keys)
        union = (several.filter("_c <> _key") if others else several).groupBy("_key").agg(F.count_distinct("_c").alias("_union"))
        counted = every.join(union, "_key", "left").select(F.col("_key").alias(key), F.struct(F.coalesce("_union", "_n").alias("n"), F.col("_first").alias("candidate"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence")).alias(f"_t{i}"))
        out = out.join(counted, key, "left")
        hits.append(F.col(f"_t{i}"))
    b = F.coalesce(*hits)
    n = F.coalesce(b["n"], F.lit(0))
    return out.select(
        *occurrences.columns,
        F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("resolution"),
        b["candidate"].alias("target"),
        F.when(n == 0, 0.0).when(n == 1, b["confidence"]).otherwise(0.5).alias("confidence"),
        F.coalesce(b["reason"], F.lit("none")).alias("reason"),
        n.cast("long").alias("n_candidates"),
    )


def candidate_sets(candidates: DataFrame, keys: list[str], candidate: str, prefer: str | None = None, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Candidates by key, factorised: (keys, set_id, n, first) and (set_id, candidate).

    A set is named by its content (its size and sums over two hashes of its
    members), so keys of equal sets share one, which is stored once, in rows: no
    set ever is one array.  ``first`` is the candidate of the least ``prefer``,
    then the least.  Sets of fewer than ``least`` members have no name and no rows.
    """
    rank = F.col(prefer) if prefer else F.lit(0)
    members = candidates.select(*keys, F.col(candidate).alias("candidate"), rank.alias("_rank")).filter(F.col("candidate").isNotNull()).groupBy(*keys, "candidate").agg(F.min("_rank").alias("_rank"))
    part = lambda seed: F.sum(F.xxhash64("candidate", F.lit(seed)).cast("decimal(20,0)"))
    content = F.when(F.count("*") >= least, F.xxhash64(F.count("*"), part(1), part(2), F.min("candidate"), F.max("candidate")))
    named = members.groupBy(*keys).agg(content.alias("set_id"), F.count("*").alias("n"), F.min(F.struct("_rank", "candidate"))["candidate"].alias("first"))
    # one key of each set stands for all
    own = named.filter("set_id is not null").groupBy("set_id").agg(F.min(F.struct(*keys)).alias("_k")).select("set_id", *(F.col(f"_k.{k}").alias(k) for k in keys))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"m.{k}").eqNullSafe(F.col(f"o.{k}"))
    return named, members.alias("m").join(own.alias("o"), condition).select("set_id", "candidate")


def first_tier(tiers: DataFrame, key: str) -> DataFrame:
    """The candidates of each key's first tier, of :func:`candidate_tiers`."""
    best = tiers.groupBy(key).agg(F.min("tier").alias("tier"))
    return tiers.join(best, [key, "tier"])


def resolve_factorised(occurrences: DataFrame, tiers: list[tuple[str, float, list[str], DataFrame]], candidate: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`resolve_tiers`, with the candidates as sets: occurrences with ``set_id``, and (set_id, candidate).

    A name with many definitions and many uses costs a row for each of either;
    :func:`set_pairs` makes their pairs where somebody reads them.
    """
    out, hits, sets = occurrences, [], None
    for i, (reason, confidence, keys, candidates) in enumerate(tiers):
        named, members = candidate_sets(candidates, keys, candidate)
        hit = F.struct("n", F.col("first").alias("candidate"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"), "set_id")
        out = out.join(named.select(*keys, hit.alias(f"_t{i}")), keys, "left")
        hits.append(F.col(f"_t{i}"))
        sets = members if sets is None else sets.unionByName(members)
    b = F.coalesce(*hits)
    n = F.coalesce(b["n"], F.lit(0))
    resolved = out.select(
        *occurrences.columns,
        F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("resolution"),
        b["candidate"].alias("target"),
        F.when(n == 0, 0.0).when(n == 1, b["confidence"]).otherwise(0.5).alias("confidence"),
        F.coalesce(b["reason"], F.lit("none")).alias("reason"),
        n.cast("long").alias("n_candidates"),
        b["set_id"].alias("set_id"),
    )
    return resolved, sets.distinct()


def set_pairs(resolved: DataFrame, sets: DataFrame, key: str, candidates: DataFrame | None = None) -> DataFrame:
    """(key, candidate) pairs of what is resolved; for some ``candidates`` (candidate) alone, if given, of whose sets nothing else is read."""
    wanted = sets if candidates is None else sets.join(candidates.select("candidate").distinct(), "candidate", "left_semi")
    return resolved.select(key, "set_id").join(wanted, "set_id").select(key, "candidate")
