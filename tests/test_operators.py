"""Small tables for what the catalogue's data doesn't show."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.functions import ranges, text
from quarrylight.operators import dedupe, diff, graph, intervals, paging, paths, refs, resolve, scope, search, summary
from quarrylight.plans import catalogue
from quarrylight.streaming import incremental


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


def w(*words):
    return [("word", x) for x in words]


@pytest.mark.parametrize(("query", "tree"), [
    ("a b", ("and", w("a", "b"))),
    ("a AND b*", ("and", [("word", "a"), ("prefix", "b")])),
    ("x a OR b OR c NOT d", ("or", [("and", w("x", "a")), ("word", "b"), ("not", ("word", "c"), ("word", "d"))])),
    ('"one two" z', ("and", [("phrase", ["one", "two"], False), ("word", "z")])),
    ('"a b" OR c', ("or", [("phrase", ["a", "b"], False), ("word", "c")])),
    ('x NOT "a b"', ("not", ("word", "x"), ("phrase", ["a", "b"], False))),
    ("pre* OR x NOT y*", ("or", [("prefix", "pre"), ("not", ("word", "x"), ("prefix", "y"))])),
    ("(a OR b) c", ("and", [("or", w("a", "b")), ("word", "c")])),
    ("a OR b AND c", ("or", [("word", "a"), ("and", w("b", "c"))])),
    ('"one tw"*', ("phrase", ["one", "tw"], True)),
    ("name:x OR text:(a b)", ("or", [("in", "name", ("word", "x")), ("in", "text", ("and", w("a", "b")))])),
    ("other:x", ("phrase", ["other", "x"], False)),
    ("a::b", ("phrase", ["a", "b"], False)),
    ('"open', ("word", "open")),
    ("OR", ("word", "or")),
    ("NOT a", ("phrase", ["not", "a"], False)),
    ("a AND (b", ("phrase", ["a", "and", "b"], False)),
    ("(" * 500 + "a" + ")" * 500, ("word", "a")),
    ("  ", None),
    ("()", None),
])
def test_query_syntax(query, tree):
    assert search.parse_query(query, ["name", "text"]).tree == tree


@settings(max_examples=200, suppress_health_check=list(HealthCheck), deadline=None)
@given(st.text(max_size=40))
def test_no_query_is_refused(query):
    assert isinstance(search.parse_query(query), search.Query)


def test_search_and_snippets(spark):
    docs = spark.createDataFrame([(1, "The Quick brown fox"), (2, "quick quick"), (3, None), (4, ""), (5, "slow brown")], "id long, text string")
    hits = {r.id: r.rank for r in search.search(docs, "quick", "id", ["text"]).collect()}
    assert set(hits) == {1, 2} and hits[2] < hits[1] < 0
    assert search.search(docs, "", "id", ["text"]).count() == 0
    assert search.search(docs, "quick NOT fox", "id", ["text"]).first().id == 2
    body = " ".join(f"w{i}" for i in range(30)) + " Fox, and fox here"
    got = one(spark, search.snippet(F.col("v"), ["fox"]), body)
    assert got.startswith("...") and got.count("<b>") == 2 and "<b>Fox,</b>" in got
    assert one(spark, search.snippet(F.col("v"), ["fox"]), "short") == "short"


def test_search_folds_diacritics(spark):
    docs = spark.createDataFrame([(1, "Caf\u00e9 noir"), (2, "cafe\u0301 au lait"), (3, "cafe"), (4, "caf")], "id long, text string")
    assert {r.id for r in search.search(docs, "cafe", "id", ["text"], folded=True).collect()} == {1, 2, 3}
    assert {r.id for r in search.search(docs, "cafe", "id", ["text"]).collect()} == {2, 3}


def test_deep_outline(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None, "n") for i in range(40)], "id long, parent long, name string")
    got = {r.id: r.level for r in graph.outline(df, "id", "parent", ["name"]).collect()}
    assert got == {i: i for i in range(40)}


def test_brackets_of_any_depth(spark):
    deep = "(" + "<" * 30 + "a, b" + ">" * 30 + " x, int y)"
    assert one(spark, text.arity(F.col("v")), deep) == 2


def test_wildcards_stay_in_buckets(spark):
    rows = spark.createDataFrame([("abc",), ("ABC",), ("xabc",), ("abd",), ("zz",)], "n string")
    assert {(r.n, r.bucket) for r in search.bucketed(rows, "abc", "n").collect()} == {("abc", 0), ("ABC", 0), ("xabc", 2)}
    assert {r.n for r in search.bucketed(rows, "ab_", "n").collect()} == {"abc", "ABC", "xabc", "abd"}


def test_pages(spark):
    df = spark.range(7)
    got = paging.page(df, [F.desc("id")], 3, 3).collect()
    assert [r.id for r in got] == [3, 2, 1] and got[0].total == 7 and got[0].has_more
    assert not paging.page(df, [F.col("id")], 3, 4).first().has_more
    assert paging.clamp(None, None) == (50, 0) and paging.clamp(0, -1) == (1, 0) and paging.clamp(999, 2) == (200, 2)


def test_line_spans(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a\r\nbé\n"), (4, "\n"), (5, "x")], "id long, t string")
    got = {(r.id, r.line): (r.start_byte, r.end_byte, r.text) for r in ranges.line_spans(df, "t", ["id"]).collect()}
    assert got == {(3, 0): (0, 1, "a"), (3, 1): (3, 6, "bé"), (3, 2): (7, 7, ""), (4, 0): (0, 0, ""), (4, 1): (1, 1, ""), (5, 0): (0, 1, "x")}


@pytest.mark.parametrize(("first", "last", "wanted"), [(0, 0, "a"), (1, 9, "b\nc"), (-5, 1, "a\nb"), (7, 9, ""), (2, 1, "")])
def test_line_slices(spark, first, last, wanted):
    assert one(spark, ranges.slice_lines(F.col("v"), F.lit(first), F.lit(last)), "a\nb\nc") == wanted


def test_byte_slices_and_columns(spark):
    assert one(spark, ranges.slice_bytes(F.col("v"), F.lit(1), F.lit(3)), "aéb") == "é"
    assert one(spark, ranges.slice_bytes(F.col("v"), F.lit(-4), F.lit(99)), "aéb") == "aéb"
    got = one(spark, ranges.column_units(F.col("v"), F.lit(5)), "a😀b")
    assert (got.code_points, got.utf16) == (2, 3)


@pytest.mark.parametrize(("signature", "arity", "normal"), [
    ("(int a, const char *b)", 2, "(int,const char *)"), ("(void)", 0, "(void)"), ("()", 0, "()"), (None, None, "()"), ("name", None, "()"),
    ("(std::map<int, long> m, int n = 3)", 2, "(std::map<int, long>,int)"), ("(void (*f)(int, int))", 1, None),
])
def test_signatures(spark, signature, arity, normal):
    assert one(spark, text.arity(F.col("v")), signature) == arity
    if normal is not None:
        assert one(spark, text.normal_signature(F.col("v")), signature) == normal


def test_names(spark):
    assert one(spark, text.scope_hierarchy(F.col("v"), "::"), "a::b::c") == ["a::b::c", "a::b", "a", ""]
    assert one(spark, text.scope_hierarchy(F.col("v")), None) == [""]
    assert one(spark, text.dotted_name(F.col("v")), "global::N::Box<List<int>>?[]") == "N.Box"
    assert one(spark, text.unquote(F.col("v")), ' "a b" ') == "a b" and one(spark, text.unquote(F.col("v")), "<x.h>") == "x.h"
    assert one(spark, text.is_dynamic(F.col("v")), "$HOME/x") and not one(spark, text.is_dynamic(F.col("v")), "./x")
    assert one(spark, text.byte_size(F.col("v")), 1536, "long") == "1.5 KB" and one(spark, text.byte_size(F.col("v")), 12, "long") == "12 B"
    legend = ["static", "readonly", "async"]
    assert one(spark, text.modifier_mask(F.array(F.lit("async"), F.lit("static"), F.lit("?")), legend)) == 5
    assert one(spark, text.mask_modifiers(F.lit(6), legend)) == ["readonly", "async"]
    assert one(spark, text.fold(F.col("v")), "Élan") == "elan"


def test_interfaces(spark):
    rows = [("f", "A::f", "void f() = 0"), ("f", "A::f", "virtual int f()"), ("f", "A::f", "virtual int f() override"), ("IShape", "IShape", None), ("In", "In", None)]
    df = spark.createDataFrame(rows, "n string, q string, s string")
    assert [r.i for r in df.select(text.looks_like_interface(F.col("n"), F.col("q"), F.col("s")).alias("i")).collect()] == [True, True, False, True, False]


def test_references_count_once(spark):
    symbols = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "id long, name string")
    rows = [(10, 1, "f", [1, 2]), (11, None, "f", None), (12, None, "zz", [3, 3]), (13, 9, "g", None), (14, None, None, [])]
    references = spark.createDataFrame(rows, "ref long, target long, name string, c array<long>")
    got = refs.referencers(references, symbols, "ref", "target", "name", "c", "id", "name")
    assert sorted((r.ref, r.symbol_id) for r in got.collect()) == [(10, 1), (10, 2), (11, 1), (11, 2), (12, 3)]


def test_smallest_enclosing_over_cells(spark):
    rnd = random.Random(0)
    spans = lambda n, width: [(i, 1, a, a + rnd.randint(0, width)) for i in range(n) for a in [rnd.randint(0, 20000)]]
    inner, outer = spans(200, 40), spans(300, 6000)
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, k long, start long, end long")
    got = {r.i: r.o for r in intervals.smallest_enclosing(frame(inner, "i"), frame(outer, "o"), ["k"], "i", "o", grid=1000).collect()}
    for i, _, a, b in inner:
        held = [(y - x, o) for o, _, x, y in outer if x <= a and y >= b]
        assert got.get(i) == (min(held)[1] if held else None)


def test_plan_reasons(spark):
    found = spark.createDataFrame([("new", "1", "c", 1), ("same", "1", "c", 1), ("edit", "2", "c", 1), ("lang", "1", "d", 1), ("meta", "1", "c", 2), ("back", "1", "c", 1), ("nohash", "1", "c", 1)], "p string, h string, l string, m int")
    stored = spark.createDataFrame([("same", "1", "c", 1, False), ("edit", "1", "c", 1, None), ("lang", "1", "c", 1, False), ("meta", "1", "c", 1, False), ("back", "1", "c", 1, True), ("nohash", None, "c", 1, False), ("gone", "1", "c", 1, False), ("dead", "1", "c", 1, True)], "p string, h string, l string, m int, d boolean")
    got = {r.path: (r.action, r.reason) for r in diff.plan(found, stored, "p", "h", "l", ["m"], "d").collect()}
    assert got == {"new": ("process", "new"), "same": ("skip", "unchanged"), "edit": ("process", "content_changed"), "lang": ("process", "language_changed"), "meta": ("touch", "metadata_changed"), "back": ("process", "recreated"), "nohash": ("process", "content_changed"), "gone": ("remove", "missing")}
    forced = {r.path: r.reason for r in diff.plan(found, stored, "p", "h", deleted="d", force=True).collect()}
    assert forced["same"] == "forced" and forced["new"] == "new"
    assert diff.forget_hashes(stored, "h", F.col("p") == "same").filter("p = 'same'").first().h is None


def test_tiers(spark):
    occ = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "o long, n string")
    near = spark.createDataFrame([(1, 10), (1, 10), (2, 21), (2, 20)], "o long, s long")
    far = spark.createDataFrame([(1, 99), (3, 30)], "o long, s long")
    tiers = resolve.candidate_tiers([("near", 1.0, near), ("far", 0.8, far)], "o", "s")
    got = {r.o: (r.resolution, r.target, r.confidence, r.reason) for r in resolve.resolve(occ, "o", tiers).collect()}
    assert got == {1: ("resolved", 10, 1.0, "near"), 2: ("ambiguous", 20, 0.5, "near"), 3: ("resolved", 30, 0.8, "far"), 4: ("unresolved", None, 0.0, "none")}
    names = spark.createDataFrame([("a", 10), ("b", 21), ("b", 20), ("b", 20)], "n string, s long")
    got = {r.o: (r.resolution, r.target, r.n_candidates) for r in resolve.resolve_tiers(occ, [("near", 1.0, ["n"], names)], "s").collect()}
    assert got == {1: ("resolved", 10, 1), 2: ("ambiguous", 20, 2), 3: ("unresolved", None, 0), 4: ("unresolved", None, 0)}


def test_more_tiers_never_unresolve(spark):
    rnd = random.Random(4)
    occ = spark.createDataFrame([(i,) for i in range(30)], "o long")
    tiers = [("t", 0.9, spark.createDataFrame([(rnd.randrange(30), rnd.randrange(9)) for _ in range(12)], "o long, s long")) for _ in range(3)]
    open_ = [{r.o for r in resolve.resolve(occ, "o", resolve.candidate_tiers(tiers[:k], "o", "s")).filter("resolution = 'unresolved'").collect()} for k in (1, 2, 3)]
    assert open_[0] >= open_[1] >= open_[2]


def test_closure_and_expansion(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 1, "x"), (1, 4, "y"), (5, 1, "calls"), (6, 7, "x"), (None, 2, "x")], "s long, t long, k string")
    starts = spark.createDataFrame([(1,), (6,)], "n long")
    got = {(r.root, r.node): r.level for r in graph.closure(edges, starts, "s", "t", "n").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 4): 1, (1, 3): 2, (6, 6): 0, (6, 7): 1}
    assert {(r.root, r.node) for r in graph.closure(edges, starts, "s", "t", "n", depth=1).collect()} == {(1, 1), (1, 2), (1, 4), (6, 6), (6, 7)}
    nodes, out, cut = graph.expand(edges, 1, "s", "t", "k", ["x"], depth=2)
    assert {r.id for r in nodes.collect()} == {1, 2, 5, 3} and not cut
    assert {(r.source, r.target) for r in out.collect()} == {(1, 2), (5, 1), (2, 3)}
    nodes, out, cut = graph.expand(edges, 1, "s", "t", "k", depth=3, max_nodes=2, max_edges=3)
    assert cut and nodes.count() == 2 and out.count() == 3 and out.filter("dangling").count() >= 1


def test_outline_of_orphans_and_loops(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, 1, "y"), (3, 1, "x"), (4, 99, "a"), (5, 6, "p"), (6, 5, "q")], "id long, parent long, name string")
    got = {r.id: (r.level, r.place) for r in graph.outline(df, "id", "parent", ["name"]).collect()}
    assert got[1][0] == 0 and got[4][0] == 0 and got[3] == (1, 1) and got[2] == (1, 2)
    assert got[5][0] == 0 and got[6][0] == 1 and len(got) == 6  # a cycle begins at its smallest member


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c",), ("a/d",), ("e",), ("a",), ("ab/x",)], "p string")
    assert [(r.name, r.is_dir) for r in paths.children(df, "p", "a").collect()] == [("b", True), ("d", False)]
    assert [(r.name, r.is_dir) for r in paths.children(df, "p").collect()] == [("a", True), ("ab", True), ("e", False)]
    known = spark.createDataFrame([("x/y.h", 1), ("z/y.h", 2), ("x/u.h", 3)], "p string, id long")
    names = spark.createDataFrame([("y.h",), ("x/y.h",), ("u.h",), ("q.h",)], "n string")
    assert {(r.n, r.id) for r in paths.unique_suffix(names, "n", known, "p", "id").collect()} == {("x/y.h", 1), ("u.h", 3)}


def test_scope(spark):
    owners = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    links = spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")
    pairs = scope.visibility(owners, "id", links)
    assert {(r.viewer, r.owner) for r in pairs.collect()} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 3)}
    rows = spark.createDataFrame([(1, 2, 7, "resolved"), (1, 3, 8, "resolved")], "viewer long, owner long, target long, state string")
    assert {(r.target, r.state) for r in scope.redact(rows, "viewer", "owner", ["target"], "state", pairs).collect()} == {(7, "resolved"), (None, "unresolved")}


def test_latest_and_first(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, None)], "k long, t long, v string")
    assert sorted((r.k, r.v) for r in summary.latest(df, ["k"], ["t"]).collect()) == [(1, "b"), (2, None)]
    assert sorted((r.k, r.v) for r in dedupe.first_by(df, ["k"], ["t"]).collect()) == [(1, "a"), (2, None)]
    assert summary.conditional_counts(df, {"five": F.col("t") == 5}).first().asDict() == {"total": 3, "five": 1, "other": 2}


def test_stream_of_files(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    schema = "path string, content_hash string, seq long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stored = {"a": "1"}
    current = lambda: spark.createDataFrame(list(stored.items()), "path string, content_hash string")

    def apply(df, number):
        for r in df.collect():
            stored[r.path] = r.content_hash
            seen.append((r.path, r.content_hash))

    write([("a", "1", 1), ("b", "1", 1), ("b", "2", 2)])
    run = lambda: incremental.run_incremental(incremental.stream_files(spark, str(folder), schema), current, apply, str(tmp_path / "cp")).awaitTermination()
    run()
    assert seen == [("b", "2")]
    write([("a", "3", 3), ("b", "2", 3)])
    run()
    assert seen == [("b", "2"), ("a", "3")]


def test_stream_of_events(spark, tmp_path):
    from datetime import datetime

    folder = str(tmp_path / "ev")
    rows = [(datetime(2024, 1, 1, h, m), k) for h, m, k in [(1, 0, "a"), (1, 59, "a"), (2, 0, "a"), (1, 5, "b")]]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(folder)
    stream = incremental.event_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(folder))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start.hour, r.event_type, r.n) for r in spark.table("counts").collect()) == [(1, "a", 2), (1, "b", 1), (2, "a", 1)]


def test_resolve_keeps_all_candidates(spark):
    calls = spark.createDataFrame([(1, "get")], "id long, n string")
    symbols = spark.createDataFrame([("get", i) for i in range(100)], "n string, s long")
    by_key = resolve.resolve_tiers(calls, [("near", 1.0, ["n"], symbols)], "s").first()
    tiers = resolve.candidate_tiers([("near", 1.0, calls.join(symbols, "n").select("id", "s"))], "id", "s")
    assert by_key.candidates == resolve.resolve(calls, "id", tiers).first().candidates == list(range(100))
    refs_ = resolve.resolve_tiers(calls, [("near", 1.0, ["n"], symbols)], "s")
    found = refs.referencers(refs_, symbols, "id", "target", "n", "candidates", "s", "n").collect()
    assert {r.symbol_id for r in found} == set(range(100))


def test_counted_candidates_equal_listed_ones(spark):
    rnd = random.Random(5)
    some = lambda n: rnd.choice([None, *range(n)])
    uses = spark.createDataFrame([(some(25), some(4), some(5)) for _ in range(60)] + [(90, None, 2), (91, 9, None), (92, 8, 77), (93, 1, 1)], "o long, x int, y int").distinct()
    far = spark.createDataFrame([(some(5), rnd.randrange(30)) for _ in range(20)] * 2, "y int, c long")
    near = uses.select("x", F.col("o").alias("c"))
    listed = resolve.candidate_tiers([("near", 1.0, uses.join(near, "x").filter("o <> c").select("o", "c")), ("far", 0.8, uses.join(far, "y").select("o", "c"))], "o", "c")
    wanted = resolve.resolve(uses, "o", listed).drop("candidates")
    got = resolve.resolve_counted(uses, "o", [("near", 1.0, ["x"], near, True), ("far", 0.8, ["y"], far, False)], "c")
    assert got.columns == wanted.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


def test_alike_parts_are_counted_without_their_pairs(spark, tmp_path):
    n = 30_000  # 900 million pairs
    spark.range(n).selectExpr("id p_partkey", "'b' p_brand", "'t' p_type", "1 p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1).selectExpr("id s_suppkey", "1 s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = catalogue.candidate_tiers(spark, str(tmp_path))
    read = _rows_joined(rows)
    assert {(r.resolution, r.target, r.n_candidates) for r in rows.collect()} == {("ambiguous", 0, n - 1), ("ambiguous", 1, n - 1)}
    assert read() < 20 * n


def test_pairs_of_a_common_name_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(refs, "CELL_ROWS", 10)
    rows = [(o, n, 1000 * o + i) for o in (1, 2, 3) for n, size in (("hot", 95), ("rare", 2 * o - 3)) for i in range(size)] + [(1, None, 7), (2, None, 8), (None, "hot", 9), (2, "hot", None), (1, "hot", 1000)]
    members = spark.createDataFrame(rows, "o int, n string, m long")
    links = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (2, 1), (4, 1), (None, 1)], "derived int, base int")
    got = refs.pairs_by_name(members, members, links, "o", "n", "m")
    wanted = [(x, y, n, a, b) for x, y in ((2, 1), (3, 1), (3, 2)) for o, n, a in rows if o == x and n for p, k, b in rows if p == y and k == n]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))
    used = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(used) > 50 and max(r["count"] for r in used) < len(wanted) / 10


def test_smallest_enclosing_compares_equal_ranges_once(spark):
    inner = spark.range(3000).selectExpr("id i", "1 k", "5 + id % 3 start", "8 + id % 3 end")
    outer = spark.range(3000).selectExpr("id o", "1 k", "id % 4 start", "20 - id % 2 end")
    rows = intervals.smallest_enclosing(inner, outer, ["k"], "i", "o")
    read = _rows_joined(rows)
    assert {(r.i, r.o) for r in rows.collect()} == {(i, 3) for i in range(3000)}
    assert read() < 20_000
    odd = spark.createDataFrame([(1, 1, 4, 5), (1, 1, 40, 41), (2, 1, None, 3), (3, None, 1, 2), (4, 2, 1, 2)], "i long, k int, start long, end long")
    held = spark.createDataFrame([(9, 1, 0, 6), (8, 1, 1, 7), (7, 1, 38, 42), (6, 1, None, 9), (5, None, 0, 9)], "o long, k int, start long, end long")
    assert [(r.k, r.i, r.o) for r in intervals.smallest_enclosing(odd, held, ["k"], "i", "o").collect()] == [(1, 1, 7)]


def _rows_joined(df):
    """A function that tells how many rows the joins of a frame that has run gave, as its final plan counts them."""

    def read():
        total, left = 0, [df._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                left.append(node.executedPlan())
                continue
            if kind.endswith("QueryStageExec"):
                left.append(node.plan())
                continue
            if kind.endswith("JoinExec"):
                total += node.metrics().apply("numOutputRows").value()
            left += [node.children().apply(i) for i in range(node.children().size())]
        return total

    return read
