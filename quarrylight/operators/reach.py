"""Reachability without pairs: strongly connected components, and labels over the graph that they condense to.

Components.  Nodes with one way in and one way out are taken out first: pointer
jumping folds each run of them into one edge in as many rounds as the logarithm
of its length.  Of what is left, nodes that nothing enters or leaves are
components by themselves; the others are coloured forwards with the greatest
node that reaches them, and those that reach their colour's node backwards,
within the colour, are its component.  That is repeated on the rest.

Labels.  The condensed graph is covered by chains: each node goes on to one
successor, which accepts one of those that want it, and pointer jumping gives
every node its place in its chain.  A node's label holds, for each chain that it
reaches, the first place that it reaches there; it reaches that and all later
ones.  Rounds carry labels over edges between chains, and within a chain one
window carries them to all nodes before, so a chain of any length takes one
round.  A label has at most one entry for each chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.graph import checkpoint, holding


def _empty(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], columns)


def _steps(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.select(F.col(source).cast("long").alias("s"), F.col(target).cast("long").alias("t")).filter("s is not null and t is not null and s <> t").distinct()


def _jumped(next_: DataFrame) -> DataFrame:
    """(id, end, hops, least): where following ``next_`` (id, to) leads, by doubling; nodes whose way never ends have no end and the least node of their cycle.

    Every node has one way on at most, and each is the way on of one at most.
    """
    at = checkpoint(next_.select("id", F.col("to").alias("end"), F.lit(1).cast("long").alias("hops"), F.least("id", "to").alias("least")))
    total, span = at.count(), 1
    while total:
        on = at.select(F.col("id").alias("end"), F.col("end").alias("_end"), F.col("hops").alias("_hops"), F.col("least").alias("_least"))
        both = at.join(on, "end", "left")
        moved = checkpoint(both.select("id", F.coalesce("_end", "end").alias("end"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.least("least", "_least").alias("least"), F.col("_end").isNull().alias("_done")))
        left = moved.filter("not _done").count()
        if left and span >= 2 * total:  # whose way is longer than there are nodes goes round
            return moved.select("id", F.when(F.col("_done"), F.col("end")).alias("end"), "hops", "least")
        at, span = moved.drop("_done"), 2 * span
        if not left:
            break
    return at


def components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, component) for every node of an edge; nodes that reach each other share their least node."""
    with holding() as keep:
        steps = keep(_steps(edges, source, target))
        raw = edges.select(F.explode(F.array(F.col(source).cast("long"), F.col(target).cast("long"))).alias("node")).filter("node is not null").distinct()
        ins, outs = steps.groupBy(F.col("t").alias("id")).agg(F.count("*").alias("n_in"), F.min("s").alias("from")), steps.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("n_out"), F.min("t").alias("to"))
        single = keep(ins.join(outs, "id").filter("n_in = 1 and n_out = 1").select("id", "from", "to"))
        inner = single.select("id")
        run = _jumped(single.join(inner.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to"))
        cycles = run.filter("end is null").select(F.col("id").alias("node"), F.col("least").alias("component"))
        # the last of each run, and the edge that the run stands for
        last = single.select("id", F.col("id").alias("last")).join(run.select("id"), "id", "left_anti").unionByName(run.filter("end is not null").select("id", F.col("end").alias("last")))
        first = single.join(inner.select(F.col("id").alias("from")), "from", "left_anti").select("id", "from")
        ways = keep(first.join(last, "id").join(single.select(F.col("id").alias("last"), "to"), "last").select("last", F.col("from").alias("s"), F.col("to").alias("t")))
        kept = steps.join(inner.select(F.col("id").alias("s")), "s", "left_anti").join(inner.select(F.col("id").alias("t")), "t", "left_anti")
        found = keep(_coloured(kept.unionByName(ways.select("s", "t").filter("s <> t")).distinct()))
        # a run is part of a component where both its ends are
        of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        sides = ways.join(of("s"), "s", "left").join(of("t"), "t", "left")
        joined = sides.filter((F.col("s") == F.col("t")) | (F.col("_s") == F.col("_t"))).select("last", F.coalesce("_s", "s").alias("component"))
        members = last.join(joined, "last").select(F.col("id").alias("node"), "component")
        known = found.unionByName(members).unionByName(cycles)
        ends = joined.select(F.col("component").alias("node"), "component").distinct()  # a node whose only cycle is a run
        known = known.unionByName(ends.join(found.select("node"), "node", "left_anti"))
        least = known.groupBy("component").agg(F.min("node").alias("least"))
        named = known.join(least, "component").select("node", F.col("least").alias("component"))
        return checkpoint(raw.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")).distinct())


def _coloured(steps: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle, by trimming and by colours forwards and backwards."""
    done, before = _empty(steps, "node bigint, component bigint"), -1
    while True:
        steps = checkpoint(steps)
        n = steps.count()
        if not n:
            return done
        if n != before:  # what nothing enters or leaves lies on no cycle
            before = n
            on = steps.select(F.col("t").alias("id")).intersect(steps.select(F.col("s").alias("id")))
            steps = steps.join(on.withColumnRenamed("id", "s"), "s", "left_semi").join(on.withColumnRenamed("id", "t"), "t", "left_semi")
            continue
        colour, moved = steps.select(F.col("s").alias("id")).distinct().withColumn("colour", F.col("id")), True
        while moved:
            over = steps.join(colour.withColumnsRenamed({"id": "s", "colour": "_c"}), "s").groupBy(F.col("t").alias("id")).agg(F.max("_c").alias("_c"))
            new = checkpoint(colour.join(over, "id", "left").select("id", F.greatest("colour", "_c").alias("colour"), (F.col("_c") > F.col("colour")).alias("_moved")))
            moved, colour = new.filter("_moved").count() > 0, new.drop("_moved")
        alike = steps.join(colour.withColumnsRenamed({"id": "s", "colour": "_a"}), "s").join(colour.withColumnsRenamed({"id": "t", "colour": "_b"}), "t").filter("_a = _b").select("s", "t")
        inside = checkpoint(alike)
        front = members = checkpoint(colour.filter("id = colour"))
        while front.count():
            back = inside.join(front.withColumnRenamed("id", "t"), "t").select(F.col("s").alias("id"), "colour").distinct()
            front = checkpoint(back.join(members.select("id"), "id", "left_anti"))
            members = members.unionByName(front)
        members = checkpoint(members)
        sizes = members.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1")
        done = done.unionByName(members.join(sizes.select("colour"), "colour", "left_semi").select(F.col("id").alias("node"), F.col("colour").alias("component")))
        gone = members.select("id")
        steps = steps.join(gone.withColumnRenamed("id", "s"), "s", "left_anti").join(gone.withColumnRenamed("id", "t"), "t", "left_anti")


@dataclass
class Reach:
    """Who reaches whom: ``members`` (node, component), ``places`` (component, chain, place), ``labels`` (component, chain, first) and ``cyclic`` (component)."""

    members: DataFrame
    places: DataFrame
    labels: DataFrame
    cyclic: DataFrame

    def pairs(self, roots: DataFrame | None = None) -> DataFrame:
        """(root, node) of all nodes, or of some roots (node): what each reaches in one step or more, made from the labels as it is read."""
        starts = self.members if roots is None else self.members.join(roots.select("node").distinct(), "node", "left_semi")
        start = starts.select(F.col("node").alias("root"), "component")
        there = self.places.select(F.col("component").alias("_c"), "chain", "place")
        later = self.labels.join(there, "chain").filter("place >= first").select("component", "_c")
        others = later.filter("component <> _c").unionByName(self.cyclic.select("component", F.col("component").alias("_c")))
        return start.join(others, "component").join(self.members.select("node", F.col("component").alias("_c")), "_c").select("root", "node")

    def reaches(self, asked: DataFrame) -> DataFrame:
        """``asked`` (root, node) with ``reached``, by one look at the root's label of the node's chain: nothing is expanded."""
        q = asked.join(self.members.withColumnsRenamed({"node": "root", "component": "_r"}), "root", "left").join(self.members.withColumnsRenamed({"component": "_n"}), "node", "left")
        q = q.join(self.places.select(F.col("component").alias("_n"), F.col("chain").alias("_chain"), "place"), "_n", "left")
        q = q.join(self.labels.select(F.col("component").alias("_r"), F.col("chain").alias("_chain"), "first"), ["_r", "_chain"], "left")
        q = q.join(self.cyclic.select(F.col("component").alias("_r"), F.lit(True).alias("_loops")), "_r", "left")
        reached = F.when(F.col("_r") == F.col("_n"), F.coalesce("_loops", F.lit(False))).otherwise(F.coalesce(F.col("first") <= F.col("place"), F.lit(False)))
        return q.select(*asked.columns, reached.alias("reached"))


def reach(edges: DataFrame, source: str, target: str) -> Reach:
    """Components and labels of a graph; loops and repeated edges are allowed, null ends are no edges."""
    members = components(edges, source, target)
    of = lambda end: members.withColumnsRenamed({"node": end, "component": f"_{end}"})
    whole = edges.select(F.col(source).cast("long").alias("s"), F.col(target).cast("long").alias("t")).filter("s is not null and t is not null")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    loops = whole.filter("s = t").select(F.col("s").alias("node")).join(members, "node").select("component")
    cyclic = checkpoint(sizes.filter("n > 1").select("component").unionByName(loops).distinct())
    dag = checkpoint(whole.join(of("s"), "s").join(of("t"), "t").filter("_s <> _t").select(F.col("_s").alias("s"), F.col("_t").alias("t")).distinct())
    places = _chains(members.select(F.col("component").alias("id")).distinct(), dag)
    return Reach(members, places, _labels(places, dag), cyclic)


def _chains(nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """(component, chain, place): a cover by chains, each named by its last node; places grow along the edges."""
    ins = dag.groupBy("t").agg(F.count("*").alias("_in"))
    # the successor that fewest want, so that more are accepted
    wish = dag.join(ins, "t").groupBy("s").agg(F.min(F.struct("_in", "t"))["t"].alias("t"))
    taken = wish.groupBy("t").agg(F.min("s").alias("s")).select(F.col("s").alias("id"), F.col("t").alias("to"))
    run = _jumped(taken)
    placed = nodes.join(run, "id", "left").select(F.col("id").alias("component"), F.coalesce("end", "id").alias("chain"), (-F.coalesce("hops", F.lit(0))).alias("place"))
    return checkpoint(placed)


def _labels(places: DataFrame, dag: DataFrame) -> DataFrame:
    """(component, chain, first): the first place of each chain that a node reaches, its own included."""
    own = places.select(F.col("component").alias("_c"), F.col("chain").alias("_own"), "place")
    cross = dag.join(own.select(F.col("_c").alias("s"), F.col("_own").alias("_a")), "s").join(own.select(F.col("_c").alias("t"), F.col("_own").alias("_b")), "t").filter("_a <> _b").select("s", "t")
    cross = checkpoint(cross)
    # entries at the places where they come in; what stands before on the chain has them too
    known = checkpoint(places.select("component", "chain", F.col("place").alias("first")))
    fresh = known
    while True:
        # over edges between chains; an entry of the node's own chain is later than itself and adds nothing
        over = cross.join(fresh.withColumnRenamed("component", "t"), "t").groupBy(F.col("s").alias("component"), "chain").agg(F.min("first").alias("first"))
        over = over.join(own.select(F.col("_c").alias("component"), "_own", "place"), "component").filter("chain <> _own")
        # back along the chain: the least entry at a place or a later one; a row for each label entry, no pair of places
        back = over.groupBy("_own", "chain", "place").agg(F.min("first").alias("first"))
        every = own.join(back.select("_own", "chain").distinct(), "_own").join(back, ["_own", "chain", "place"], "left")
        later = Window.partitionBy("_own", "chain").orderBy(F.desc("place"))
        spread = every.withColumn("first", F.min("first").over(later)).filter("first is not null").select(F.col("_c").alias("component"), "chain", "first")
        old = known.withColumnRenamed("first", "_old")
        fresh = checkpoint(spread.join(old, ["component", "chain"], "left").filter("_old is null or first < _old").drop("_old"))
        if not fresh.count():
            return known
        known = checkpoint(known.unionByName(fresh).groupBy("component", "chain").agg(F.min("first").alias("first")))
