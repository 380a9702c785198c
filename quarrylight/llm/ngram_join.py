"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's shingles are put in one global order (that of their hashes), so
two sets with J >= t that are cut to their p lowest shingles, p = n - ceil(t n)
+ l, share at least l of them.  Texts with equal sets become one class first.
Then every class lengthens its prefix by its estimated candidate cost: shingles
that more than ``common`` classes hold give no candidates, so a class whose
prefix holds f of them takes l = f + 1 + m, and a partner must share at least
1 + m of its other shingles; m grows with the candidates those would bring.

A class that is nearly all common shingles (a large group of near copies, or
text made of passages that many share) has no such prefix: see
:func:`_among_dense`.  Candidate pairs are verified on their whole sets.

Sets are 64-bit hashes of shingles, and a class is a 64-bit hash of its set: of n
different ones, about n**2 / 2**65 pairs are taken for equal.  Defined results for odd input: a null or wordless text has an empty
set, links with nothing and is its own component; repeated rows and ids all
stay, and rows of equal sets are linked; a row whose id is null takes the
smallest id of its group, if any; very long texts are read whole; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import textops
from quarrylight.llm.graph import bounded_batches, components, written
from quarrylight.llm.skew import hot_join

WORD_CHAR = r"[^\x20\x09-\x0D]"
COMMON = 64
COST = 64
#: Members of a group of near copies that are compared at once.
OUTSIDERS, MEMBERS = 512, 1024


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The fewest shingles a set of n shares with any set it links to."""
    return -(-n * percent // 100)


def _signatures(width: int, percent: int, heads: bool):
    """Per row (id, text, key): n, class id and, with heads, the 1.5 (1 - t) n + 3 lowest shingles as packed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in textops.chunks(texts):
                sets = textops.shingle_sets(texts.slice(lo, hi - lo), width)
                n, key = _class_ids(sets)
                columns = [ids.slice(lo, hi - lo), pa.array(n), pa.array(key)]
                if heads:
                    spare = n - _least_overlap(n, percent)
                    # the plain prefix, and what a free partner may be lengthened by
                    region = spare + 1 + -(-spare // 2) + 1
                    columns.append(pa.array([s[:k].tobytes() for s, k in zip(sets, region.tolist(), strict=True)], pa.binary()))
                    columns.append(batch.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cls", "head", "key"][: len(columns)])

    return run


def _class_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in sets], np.int64)
    marks = np.array([textops.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    return n, textops.mix(marks + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _of_class(width: int):
    """(cls, text) rows whose text has that class: different rows may have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textops.chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                _, key = _class_ids(textops.shingle_sets(part.column(1), width))
                yield part.filter(pa.array(key == part.column(0).to_numpy()))

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, head) to one row per shingle of the head, with its position."""
    for batch in batches:
        for lo, hi in textops.chunks(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            arrays = [np.frombuffer(b, np.int64) for b in part.column(1).to_pylist()]
            sizes = np.array([len(a) for a in arrays])
            if not sizes.sum():
                continue
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(arrays)), pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(pos.astype(np.int32))], ["token", "cls", "pos"])


def _whole_sets(width: int):
    """(cls, text) to the whole set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textops.chunks(batch.column(1)):
                packed = [s.tobytes() for s in textops.shingle_sets(batch.column(1).slice(lo, hi - lo), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["cls", "set"])

    return run


def _overlaps(width: int):
    """(a, b, text_a, text_b) to (a, b, same, na, nb): shingles in both sets and in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for lo, hi in textops.chunks(batch.column(2), rows=64):
                part = batch.slice(lo, hi - lo)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                fresh: dict = {}
                for keys, texts in ((a, part.column(2)), (b, part.column(3))):
                    new = [i for i, k in enumerate(keys) if k not in known and k not in fresh]
                    if new:
                        fresh.update(zip([keys[i] for i in new], textops.shingle_sets(texts.take(pa.array(new)), width), strict=True))
                sets = {k: fresh.get(k, known.get(k)) for k in {*a, *b}}
                same = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)]
                size = lambda keys: pa.array([len(sets[k]) for k in keys], pa.int64())
                known = sets if sum(map(len, sets.values())) < 2_000_000 else {}
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(same, pa.int64()), size(a), size(b)], ["a", "b", "same", "na", "nb"])

    return run


def _close(na: Column, nb: Column, percent: int) -> Column:
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Exact overlaps of candidate pairs (a, b) of classes; texts has one row (cls, text) per class."""
    both = pairs.select("a", "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_overlaps(width), "a long, b long, same long, na long, nb long")


def _plan(posts: DataFrame, classes: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """(cls, n, free, reach, need): how far each class's prefix goes and what a partner must share.

    ``free`` is false where no prefix outweighs the common shingles in it; it may
    be lengthened by 0.4 (1 - t) n shingles, or to the whole set.
    """
    seen = posts.groupBy("cls").agg(
        F.sort_array(F.collect_list(F.when(F.col("df") > COMMON, F.col("pos")))).alias("at"),
        F.sum(F.when(F.col("df") <= COMMON, F.col("df") - 1)).alias("cost"),
    )
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    more = F.greatest(F.floor(F.log2(1 + F.col("cost") / COST)), F.lit(0)).cast("int")
    first = (spare + 1).cast("int")

    def reach(extra: Column) -> Column:
        inside = F.size(F.filter("at", lambda p: p < first))
        return F.aggregate(F.filter("at", lambda p: p >= first), (inside + extra).cast("int"), lambda e, p: e + F.when(p < first + e, 1).otherwise(0))

    room = (F.col("n") - first if whole else F.floor(spare * 0.4)).cast("int")
    grown = classes.join(seen, "cls").select("cls", "n", first.alias("first"), room.alias("room"), more.alias("more"), reach(F.lit(0)).alias("e0"), reach(more).alias("e1"))
    return grown.select(
        "cls",
        "n",
        (F.col("e0") <= F.col("room")).alias("free"),
        F.when(F.col("e1") <= F.col("room"), F.col("first") + F.col("e1")).otherwise(F.col("first") + F.col("e0")).alias("reach"),
        F.when(F.col("e1") <= F.col("room"), 1 + F.col("more")).otherwise(1).alias("need"),
    )


def _sparse_pairs(posts: DataFrame, plan: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs with at least one free class, from shingles that few classes hold."""
    rare = posts.filter(F.col("df") <= COMMON).select("token", "cls", "pos").join(plan, "cls").filter(~F.col("free") | (F.col("pos") < F.col("reach"))).select("token", "cls", "n", "free", "reach", "need")
    left = rare.filter("free").select("token", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("reach").alias("rx"), F.col("need").alias("ex"))
    right = rare.select("token", F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("free").alias("fy"), F.col("reach").alias("ry"), F.col("need").alias("ey"))
    # of two free classes the one with fewer extra matches sets what must be shared
    lx, ly = F.col("rx") - F.col("nx") + F.ceil(F.col("nx") * percent / 100), F.col("ry") - F.col("ny") + F.ceil(F.col("ny") * percent / 100)
    need = F.when(~F.col("fy") | (lx < ly), F.col("ex")).when(lx > ly, F.col("ey")).otherwise(F.greatest("ex", "ey"))
    return (
        left.join(right, "token")
        .filter((F.col("x") != F.col("y")) & (~F.col("fy") | (F.col("x") < F.col("y"))) & _close(F.col("nx"), F.col("ny"), percent))
        .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(need).alias("need"))
        .filter("shared >= need")
        .select("a", "b")
    )


def _linked(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.filter(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")


def _among_dense(dense: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the classes (cls, n) without a sparse prefix.

    They are counted anew, among themselves and on whole sets: a class with over
    1 - t of its shingles rare here has a prefix after all.  The rest are groups
    of near copies.
    """
    whole = written(dense.join(texts, "cls").select("cls", "text").mapInArrow(_whole_sets(width), "cls long, set binary").join(dense, "cls"))
    raw = whole.select("cls", "set").mapInArrow(_unpack, "token long, cls long, pos int")
    shared = raw.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    total = dense.agg(F.sum("n")).first()[0] or 0
    posts = written(hot_join(raw, shared, ["token"], "df", total, F.col("cls"), "inner"))
    plan = written(_plan(posts, dense, percent, whole=True))
    links = written(_linked(verify(_sparse_pairs(posts, plan, percent), texts, width), percent))
    sets = whole.join(plan.filter(~F.col("free")).select("cls"), "cls", "left_semi")
    return links if sets.isEmpty() else links.unionByName(written(_dense_links(sets, posts, texts, width, percent)))


def _dense_links(sets: DataFrame, posts: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that join up classes of which nine tenths of the shingles are common: groups of near copies.

    Any set c gives each set x its difference d(x) = x ^ c, and |x ^ y| is
    |d(x)| + |d(y)| - 2 |d(x) & d(y)|.  With the slack of x, (1 - t) n - (1 + t)
    |d(x)|, sets x and y link when slack(x) + slack(y) + 2 (1 + t) |d(x) & d(y)|
    is not negative.  So around a centre, the shingles that most of a group
    hold, every member whose slack and the best one's make up for each other
    links to the best member: one comparison each.  Only the outsiders that
    don't are compared with the group, in blocks, on their differences.

    The centre may be any set, so the result doesn't depend on how groups are
    formed: members whose centres have J < 0.3 can't link unless one of them is
    far from its own (|d| > n / 4); far ones are compared with all that share a
    prefix shingle with them.
    """
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    prefix = written(posts.join(sets.select("cls", "n"), "cls").filter(F.col("pos") <= spare).select("token", "cls", "n", "df"))
    hot = prefix.groupBy("cls").agg(F.max_by("token", F.struct("df", "token")).alias("h"))
    members = written(sets.join(hot, "cls"))
    total = members.count()
    sizes = members.groupBy("h").agg(F.count("*").alias("size"))
    held = members.select("h", "set").mapInArrow(_tally, "h long, token long, n long").groupBy("h", "token").agg(F.sum("n").alias("n"))
    inner = hot_join(held, sizes, ["h"], "size", total, F.col("token")).filter("2 * n > size")
    centres = written(inner.groupBy("h", "size").agg(F.sort_array(F.collect_list("token")).alias("centre")))
    alike = components(_alike(centres), "a", "b").withColumnRenamed("node", "h")
    grouped = centres.join(alike, "h", "left").withColumn("g", F.coalesce("root", "h"))
    best = grouped.groupBy("g").agg(F.max_by("centre", F.struct("size", "h")).alias("centre"))
    to_centre = grouped.select("h", "g", "size").join(best, "g").select("h", "g", "centre", "size")
    near = hot_join(members, to_centre, ["h"], "size", total, F.col("cls")).select("cls", "n", "set", "g", "centre").mapInArrow(_differences(percent), "cls long, n long, g long, slack long, far boolean, diff binary")
    near = written(near)
    tops = near.groupBy("g").agg(F.max(F.struct("slack", "cls")).alias("top"), F.count("*").alias("size"))
    placed = written(hot_join(near, tops, ["g"], "size", total, F.col("cls")).withColumn("out", F.col("slack") + F.col("top.slack") < 0))
    star = placed.filter(~F.col("out") & (F.col("cls") != F.col("top.cls"))).select(F.col("cls").alias("a"), F.col("top.cls").alias("b"))
    return star.unionByName(_outsider_links(placed, total, percent)).unionByName(_far_links(placed, prefix, texts, width, percent))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, packed set) to counts of each shingle within h, added up per chunk."""
    for batch in batches:
        for lo, hi in textops.chunks(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            arrays = [np.frombuffer(b, np.int64) for b in part.column(1).to_pylist()]
            h, token = np.repeat(part.column(0).to_numpy(), [len(a) for a in arrays]), np.concatenate(arrays)
            order = np.lexsort((token, h))
            h, token = h[order], token[order]
            new = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (token[1:] != token[:-1]))))
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(token[new]), pa.array(np.diff(np.append(new, len(h))))], ["h", "token", "n"])


def _alike(centres: DataFrame) -> DataFrame:
    """Pairs (a, b) of centres with J of 0.3 or more."""
    listed = centres.select("h", F.size("centre").alias("size"), F.explode("centre").alias("token"))
    other = listed.select(F.col("h").alias("h2"), F.col("size").alias("size2"), "token")
    same = listed.join(other, "token").filter("h < h2").groupBy("h", "h2", "size", "size2").agg(F.count("*").alias("same"))
    return same.filter("10 * same >= 3 * (size + size2 - same)").select(F.col("h").alias("a"), F.col("h2").alias("b"))


def _differences(percent: int):
    """(cls, n, set, g, centre) to (cls, n, g, slack, far, packed difference)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textops.chunks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                n = part.column(1).to_numpy()
                diffs = [np.setxor1d(np.frombuffer(s, np.int64), c, assume_unique=True) for s, c in zip(part.column(2).to_pylist(), (x.values.to_numpy() for x in part.column(4)), strict=True)]
                size = np.array([len(d) for d in diffs], np.int64)
                slack = (100 - percent) * n - (100 + percent) * size
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(slack), pa.array(4 * size > n), pa.array([d.tobytes() for d in diffs], pa.binary())], ["cls", "n", "g", "slack", "far", "diff"])

    return run


def _outsider_links(placed: DataFrame, total: int, percent: int) -> DataFrame:
    """Outsiders of each group against its members, OUTSIDERS by MEMBERS at a time."""
    out = placed.filter("out").groupBy("g").agg(F.count("*").alias("n_out"))
    counts = placed.groupBy("g").agg(F.first("size").alias("size")).join(out, "g")
    counts = counts.select("g", F.ceil(F.col("n_out") / OUTSIDERS).cast("int").alias("obs"), F.ceil(F.col("size") / MEMBERS).cast("int").alias("mbs"), "size")
    dealt = hot_join(placed.drop("size"), counts, ["g"], "size", total, F.col("cls"), "inner")
    block = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.filter("out").select("cls", "slack", "diff", "g", block("obs", 0).alias("ob"), each("mbs").alias("mb"))
    right = dealt.select("cls", "slack", "diff", "out", "g", block("mbs", 1).alias("mb"), each("obs").alias("ob")).toDF("cls2", "slack2", "diff2", "out2", "g2", "mb2", "ob2")
    return left.groupBy("g", "ob", "mb").cogroup(right.groupBy("g2", "ob2", "mb2")).applyInArrow(_compare(percent), "a long, b long")


def _compare(percent: int):
    """Links of outsiders with members, as few as join up the same classes.

    The members within reach of the best one are one component already, so an
    outsider needs but one link to any of them.
    """
    weight = 2 * (100 + percent)

    def run(outsiders: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        if outsiders.num_rows and members.num_rows:
            cls, slack, out = members["cls2"].to_numpy(), members["slack2"].to_numpy(), members["out2"].to_numpy()
            diffs = [np.frombuffer(d, np.int64) for d in members["diff2"].to_pylist()]
            token, row = np.concatenate(diffs), np.repeat(np.arange(len(diffs)), [len(d) for d in diffs])
            order = np.argsort(token, kind="stable")
            token, row = token[order], row[order]
            root: dict = {}

            def find(x):
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            for x, sx, d in zip(outsiders["cls"].to_pylist(), outsiders["slack"].to_pylist(), outsiders["diff"].to_pylist(), strict=True):
                own = np.frombuffer(d, np.int64)
                lo, hi = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
                shared = np.bincount(np.concatenate([row[i:j] for i, j in zip(lo, hi, strict=True)] or [row[:0]]), minlength=len(cls))
                ok = (sx + slack + weight * shared >= 0) & (cls != x)
                inside = np.flatnonzero(ok & ~out)
                for y in [*cls[ok & out].tolist(), *cls[inside[:1]].tolist()]:
                    p, q = find(x), find(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(x)
                        b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _far_links(placed: DataFrame, prefix: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Members far from their centre against those of other groups that share a prefix shingle."""
    known = placed.select("cls", "g", "far")
    tokens = prefix.select("token", "cls", "n").join(known, "cls")
    left = tokens.filter("far").select("token", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("g").alias("gx"))
    pairs = (
        left.join(tokens.select("token", F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("g").alias("gy")), "token")
        .filter((F.col("gx") != F.col("gy")) & _close(F.col("nx"), F.col("ny"), percent))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    return _linked(verify(pairs, texts, width), percent)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): the key is a hash of both, so only rows that repeat an id with its text share one."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def _classes(source: DataFrame, width: int, percent: int) -> tuple[DataFrame, int]:
    """(cls, rows, least_id, key, component_id, component_key) per class, and the number of rows with words.

    ``key`` is that of the class's row of the smallest id, null ids last.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be within 80 to 100")
    bounded_batches(source.sparkSession)
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = source.mapInArrow(_signatures(width, percent, True), f"doc_id {kind}, n long, cls long, head binary, key long")
    # copies meet in their class before any shingle is dealt out; one row's key stands for the class's text
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "head")).alias("m")
    copies = signed.filter("n > 0").groupBy("cls", "n").agg(first, F.count("*").alias("rows"))
    classes = written(copies.select("cls", "n", "rows", F.col("m.doc_id").alias("least_id"), "m.key", "m.head"))
    n_rows, n_heads = (x or 0 for x in classes.agg(F.sum("rows"), F.sum(F.octet_length("head"))).first())
    raw = classes.select("cls", "head").mapInArrow(_unpack, "token long, cls long, pos int")
    shared = raw.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    posts = written(hot_join(raw, shared, ["token"], "df", n_heads // 8, F.col("cls"), "inner"))
    plan = written(_plan(posts, classes, percent))
    pairs = written(_sparse_pairs(posts, plan, percent))
    dense = plan.filter(~F.col("free")).select("cls", "n")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(dense.select("cls")).distinct()
    reps = classes.join(needed, "cls", "left_semi").select("key", "cls", "rows")
    found = hot_join(source.select("key", "text"), reps, ["key"], "rows", n_rows, F.monotonically_increasing_id(), "inner")
    texts = written(found.select("cls", "text").mapInArrow(_of_class(width), "cls long, text string").groupBy("cls").agg(F.first("text").alias("text")))
    links = written(_linked(verify(pairs, texts, width), percent))
    if not dense.isEmpty():
        links = links.unionByName(_among_dense(dense, texts, width, percent))
    ids = components(links).withColumnRenamed("node", "cls").join(classes.select("cls", "least_id", "key"), "cls")
    least = ids.groupBy("root").agg(F.min(F.struct(F.isnull("least_id").alias("none"), "least_id", "key")).alias("m"))
    merged = ids.join(least, "root").select("cls", F.col("m.least_id").alias("least"), F.col("m.key").alias("first_key"))
    # a table of its own, so that what reads it reads it once
    known = classes.select("cls", "rows", "least_id", "key").join(merged, "cls", "left")
    return written(known.select("cls", "rows", "least_id", "key", F.coalesce("least", "least_id").alias("component_id"), F.coalesce("first_key", "key").alias("component_key"))), n_rows


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: its id, set size (``n_shingles``) and ``component_id``.

    The lengthened prefixes are long enough for thresholds from 80 percent.
    """
    source = _rows(docs, id_col, text_col)
    known, n_rows = _classes(source, width, percent)
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.select("doc_id", "text").mapInArrow(_signatures(width, percent, False), f"doc_id {kind}, n long, cls long")
    named = hot_join(rows, known.select("cls", "rows", "component_id"), ["cls"], "rows", n_rows, F.monotonically_increasing_id())
    return named.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, whole, with one row of each group of near duplicates: that of the smallest id, null ids last.

    Of rows that repeat an id with its text one stays.  Rows without words, which
    are nobody's duplicates, all stay.
    """
    key = F.xxhash64(id_col, F.col(text_col).cast("string")).alias("__key")
    source = _rows(docs, id_col, text_col)
    known, _ = _classes(source, width, percent)
    keyed = docs.select("*", key)
    wordless = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(WORD_CHAR)
    kept = known.filter("key = component_key").select(F.col("key").alias("__key"))
    often = written(source.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("__key")).join(kept, "__key", "left_semi"))
    once = keyed.join(kept.withColumn("__kept", F.lit(True)), "__key", "left").filter(F.col("__kept") | wordless).drop("__kept")
    if not often.isEmpty():
        once = once.join(often, "__key", "left_anti").unionByName(keyed.join(often, "__key", "left_semi").dropDuplicates(["__key"]))
    return once.drop("__key")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) END AS g FROM w
), t AS MATERIALIZED (
  SELECT doc_id, len(g) AS n, unnest(g) AS token FROM s
), p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), c AS (
  SELECT doc_id AS x, doc_id AS r FROM s UNION SELECT p.y, c.r FROM c JOIN p ON p.x = c.x
)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(c.r) AS component_id FROM s JOIN c ON c.x = s.doc_id GROUP BY s.doc_id, g
"""
