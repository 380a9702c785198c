"""Components, reachability labels, expansion from many roots, set containment, factorised candidates, coordinates."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import coordinates
from quarrylight.operators import containment, graph, reach, refs, resolve


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "s long, t long") if pairs else spark.createDataFrame([], "s long, t long")


def plain_reach(pairs):
    out = {}
    for s, t in pairs:
        if s is not None and t is not None:
            out.setdefault(s, set()).add(t)
    found = {}
    for root in {x for p in pairs for x in p if x is not None}:
        seen, left = set(), list(out.get(root, ()))
        while left:
            n = left.pop()
            if n not in seen:
                seen.add(n)
                left += out.get(n, ())
        found[root] = seen
    return found


def random_graph(seed):
    rnd = random.Random(seed)
    n = rnd.choice([8, 20, 40])
    return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(n * rnd.choice([0.8, 1.2, 2])))]


CYCLE = [(i, (i + 1) % 30) for i in range(30)]
GRAPHS = [
    [],
    [(1, 1)],
    [(1, 2), (2, 1), (None, 3), (4, None)],
    CYCLE,
    CYCLE + [(i + 100, i + 101) for i in range(20)] + [(5, 100), (120, 50), (50, 51), (51, 50)],
    [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 6), (7, 1), (5, 8), (1, 2)],
    [(a, b) for a in range(4) for b in range(10, 14)] + [(12, 20), (20, 21)],
    *(random_graph(i) for i in range(5)),
]


@pytest.mark.parametrize("pairs", GRAPHS)
def test_labels_equal_a_search_from_every_node(spark, pairs):
    wanted = plain_reach(pairs)
    found = reach.reach(edges_of(spark, pairs), "s", "t")
    component = {r.node: r.component for r in found.members.collect()}
    assert component == {n: min([n, *(m for m in seen if n in wanted[m])]) for n, seen in wanted.items()}
    assert Counter(map(tuple, found.pairs().collect())) == Counter((r, n) for r, seen in wanted.items() for n in seen)
    if pairs:
        some = sorted(wanted)[:3]
        roots = spark.createDataFrame([(n,) for n in some], "node long")
        assert {tuple(r) for r in found.pairs(roots).collect()} == {(r, n) for r in some for n in wanted[r]}
        asked = spark.createDataFrame([(r, n) for r in sorted(wanted) for n in [*sorted(wanted)[:6], 999]], "root long, node long")
        assert all(r.reached == (r.node in wanted[r.root]) for r in found.reaches(asked).collect())


def test_a_long_chain_with_cycles(spark):
    # 1,000 nodes in a row, a cycle at its head, one of 40 in its middle, and ways off and on
    pairs = [(i, i + 1) for i in range(999)] + [(3, 0), (540, 500)] + [(2000 + i, 100 * i) for i in range(10)] + [(100 * i + 50, 3000 + i) for i in range(10)]
    found = reach.reach(edges_of(spark, pairs), "s", "t")
    wanted = plain_reach(pairs)
    assert found.labels.count() < 25_000  # where the pairs are half a million
    assert found.pairs().count() == sum(map(len, wanted.values())) > 490_000
    asked = spark.createDataFrame([(0, 999), (999, 0), (520, 510), (2005, 3009), (2005, 3002), (3, 2)], "root long, node long")
    assert {(r.root, r.node): r.reached for r in found.reaches(asked).collect()} == {(0, 999): True, (999, 0): False, (520, 510): True, (2005, 3009): True, (2005, 3002): False, (3, 2): True}


def test_reach_equals_closure(spark):
    pairs = random_graph(11)
    edges = edges_of(spark, pairs)
    starts = edges.select(F.col("s").alias("node")).distinct()
    closed = {(r.root, r.node) for r in graph.closure(edges, starts, "s", "t", "node").filter("level > 0").collect()}
    assert {(r.root, r.node) for r in reach.reach(edges, "s", "t").pairs(starts).filter("root <> node").collect()} == closed


@pytest.mark.parametrize("caps", [(None, None), (5, 7), (1, 100), (100, 3), (3, 3)])
def test_expansion_from_many_roots_equals_one_by_one(spark, caps):
    rnd = random.Random(sum(c or 0 for c in caps))
    rows = [(rnd.randrange(12), rnd.randrange(12), rnd.choice(["contains", "calls", "imports"])) for _ in range(30)]
    edges = spark.createDataFrame([*rows, rows[0], (None, 3, "calls")], "s long, t long, kind string")
    roots = [0, 3, 7, 50]
    nodes, found, cuts = graph.expand_many(edges, spark.createDataFrame([(r,) for r in [*roots, 0, None]], "root long"), "s", "t", "kind", ["contains", "imports"], ["calls"], 3, *caps)
    got_nodes, got_edges, got_cuts = map(list, (nodes.collect(), found.collect(), cuts.collect()))
    for root in roots:
        n, e, cut = graph.expand(edges, root, "s", "t", "kind", ["contains", "imports"], ["calls"], 3, *caps)
        assert sorted((r.id, r.level) for r in got_nodes if r.root == root) == sorted(map(tuple, n.collect()))
        assert sorted(tuple(r)[1:] for r in got_edges if r.root == root) == sorted(map(tuple, e.collect()))
        assert [r.cut for r in got_cuts if r.root == root] == [cut]


def test_many_roots_cost_no_more_jobs(spark):
    edges = spark.range(3000).select(F.col("id").alias("s"), (F.col("id") * 7 % 3000).alias("t"), F.lit("calls").alias("kind"))

    def jobs(n):
        spark.sparkContext.setJobGroup(f"roots-{n}", "")
        nodes, found, _ = graph.expand_many(edges, spark.range(1, n + 1).withColumnRenamed("id", "root"), "s", "t", "kind", ["calls"], ["calls"], 2, 5, 5)
        assert nodes.select("root").distinct().count() == n and found.select("root").distinct().count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"roots-{n}"))

    one, many = jobs(1), jobs(1000)
    spark.sparkContext._jsc.clearJobGroup()
    assert many <= 1.3 * one


def test_set_containment(spark):
    rnd = random.Random(8)
    sets = {i: {rnd.randrange(25) for _ in range(rnd.randrange(1, 7))} for i in range(40)} | {90: {3, 999}, 91: {1}}
    owners = {i: {int(rnd.random() ** 2 * 25) for _ in range(rnd.randrange(1, 30))} for i in range(50)}
    frame = lambda held, name: spark.createDataFrame([(k, e) for k, es in held.items() for e in [*es, min(es)]] + [(None, 1), (5, None)], f"{name} long, e long")
    got = containment.contained_sets(frame(sets, "i"), frame(owners, "o"), "i", "o", "e").collect()
    assert Counter(map(tuple, got)) == Counter((o, i) for i, s in sets.items() for o, have in owners.items() if s <= have)
    nothing = containment.contained_sets(frame(sets, "i").limit(0), frame(owners, "o"), "i", "o", "e")
    assert nothing.count() == 0


def test_factorised_candidates(spark):
    # a name with 1,000 definitions and 100,000 calls, beside some others
    symbols = spark.range(1000).select(F.col("id").alias("symbol"), F.lit("run").alias("name")).unionByName(spark.createDataFrame([(5000, "stop"), (5001, "go"), (5002, "go")], "symbol long, name string"))
    uses = spark.range(100_000).select("id", F.lit("run").alias("name")).unionByName(spark.createDataFrame([(200_000, "go"), (200_001, "stop"), (200_002, "nowhere"), (200_003, None)], "id long, name string"))
    resolved, sets = resolve.resolve_factorised(uses, [("name", 0.9, ["name"], symbols)], "symbol")
    resolved, sets = resolved.persist(), sets.persist()
    assert resolved.count() == 100_004 and sets.count() == 1003
    plain = resolve.resolve_tiers(uses, [("name", 0.9, ["name"], symbols)], "symbol")
    same = [c for c in plain.columns if c != "candidates"]
    assert resolved.select(same).exceptAll(plain.select(same)).count() == 0
    asked = symbols.filter("symbol in (7, 5000, 5001)")
    references = resolved.select("id", F.when(F.col("resolution") == "resolved", F.col("target")).alias("target"), "name", "set_id")
    listed = plain.select("id", F.when(F.col("resolution") == "resolved", F.col("target")).alias("target"), "name", "candidates")
    got = refs.referencers_of_sets(references, sets, asked, "id", "target", "name", "symbol", "name")
    wanted = refs.referencers(listed, asked, "id", "target", "name", "candidates", "symbol", "name")
    assert got.exceptAll(wanted.select(got.columns)).count() == 0 == wanted.select(got.columns).exceptAll(got).count()
    pairs = resolve.set_pairs(resolved, sets, "id", spark.createDataFrame([(5001,), (5002,)], "candidate long"))
    assert sorted(map(tuple, pairs.collect())) == [(200_000, 5001), (200_000, 5002)]


def test_equal_sets_are_stored_once(spark):
    rows = [(k, c) for k in ("a", "b", "c", None) for c in ((1, 2, 3) if k != "c" else (1, 2))]
    named, sets = resolve.candidate_sets(spark.createDataFrame(rows + rows, "k string, c long"), ["k"], "c")
    assert len({r.set_id for r in named.collect()}) == 2 and sets.count() == 5


TEXTS = ["", "one line", "a\nb\r\n\nc\n", "é€😀\n😀x\n", "\n", "\r\n\r\n", "😀" * 5 + "\nend"]


@pytest.mark.parametrize("unit", coordinates.UNITS)
def test_positions_equal_plain_python(spark, unit):
    rows, wanted = [], {}
    for i, text in enumerate(TEXTS):
        size = {"bytes": len(text.encode()), "points": len(text), "utf16": len(text.encode("utf-16-le")) // 2}[unit]
        offsets = [*range(-1, size + 3), None, 0]
        rows.append((i, text, offsets))
        for o in offsets:
            if o is not None:
                measure = {"bytes": lambda t: len(t.encode()), "points": len, "utf16": lambda t: len(t.encode("utf-16-le")) // 2}
                point = max(p for p in range(len(text) + 1) if measure[unit](text[:p]) <= max(o, 0))
                head = text[:point]
                own = head.rsplit("\n", 1)[-1]
                wanted[i, o] = (head.count("\n"), *(measure[u](head) for u in ("bytes", "points", "utf16")), *(measure[u](own) for u in ("bytes", "points", "utf16")))
    frame = spark.createDataFrame([*rows, (50, None, [1]), (51, "x", None)], "id long, text string, offsets array<bigint>").withColumn("starts", coordinates.line_starts(F.col("text")))
    for starts in (None, F.col("starts")):
        got = frame.select("id", "offsets", coordinates.positions(F.col("text"), F.col("offsets"), unit, starts).alias("at")).collect()
        assert {r.id: r.at for r in got if r.id >= 50} == {50: None, 51: None}
        assert {(r.id, o): tuple(p) for r in got if r.id < 50 for o, p in zip(r.offsets, r.at, strict=True) if o is not None} == wanted
        assert all(p is None for r in got if r.id < 50 for o, p in zip(r.offsets, r.at, strict=True) if o is None)


def test_line_starts(spark):
    frame = spark.createDataFrame([*enumerate(TEXTS), (50, None)], "id long, text string")
    got = {r.id: r.s for r in frame.select("id", coordinates.line_starts(F.col("text")).alias("s")).collect()}
    assert got[0] == got[50] == [] and got[2] == [0, 2, 5, 6, 8] and got[3] == [0, 10, 16]
    with pytest.raises(ValueError):
        coordinates.positions(F.col("text"), F.array(F.lit(1)), "lines")
