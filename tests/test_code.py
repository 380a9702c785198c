"""Indexing a small tree that this file writes, and what the interface says about it."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight import extract, schema
from quarrylight.api import Api
from quarrylight.extract import highlight
from quarrylight.extract import python as py
from quarrylight.extract import scanner
from quarrylight.operators import dependencies
from quarrylight.plans import indexing
from quarrylight.sources import discovery, projects
from quarrylight.sources.store import Store, last_wins

TREE = {
    "app/__init__.py": "",
    "app/base.py": 'class Shape:\n    """A shape."""\n    def area(self):\n        return 0\n\ndef helper(a, b):\n    return a + b\n',
    "app/main.py": "from app.base import Shape, helper\nimport os as system\n\nclass Square(Shape):\n    def area(self):\n        return helper(1, 2)\n\ndef run():\n    s = Square()\n    missing_thing(s)\n    return s.area()\n",
    "app/broken.py": "def oops(:\n",
    "src/geo.h": "#pragma once\nclass Geo { public: int size(); };\n",
    "src/geo.cpp": '#include "geo.h"\n#include <vector>\nnamespace g {\nclass Box : public Geo {\n  int size() { return grow(1); }\n};\nint grow(int n) { return n; }\n}\n',
    "web/index.ts": "import { b } from './lib/b';\nexport class A extends B implements C {\n  go(x: number): void { b(x); }\n}\n",
    "web/lib/b.ts": "export function b(n: number) { return n; }\n",
    "tool": "#!/usr/bin/env python3\nprint('x')\n",
    "run.sh": "source ./lib.sh\ngreet() {\n  echo hi\n}\ngreet\n",
    "lib.sh": "NAME=1\n",
    "node_modules/x.js": "var hidden = 1;\n",
    "logs/a.log": "text\n",
    "logs/keep.log": "text\n",
    ".gitignore": "*.log\n!keep.log\n",
    "data.bin": b"\x00\x01\x02",
}


def write(root, tree):
    for name, text in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, TREE)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    api = Api(store)
    ws = api.create_workspace("w", str(root))
    counts = indexing.index(spark, store, str(root), ws)
    return root, store, api, ws, counts


def ids(df, name="name"):
    return {r[name]: r["id"] for r in df.collect()}


def test_discovery(spark, indexed):
    _, store, _, ws, counts = indexed
    files = {r.path: r for r in store.table("file").collect()}
    assert set(files) == {p for p in TREE if not p.startswith("node_modules") and p != "logs/a.log"}
    job = store.table("index_job").filter(F.col("workspace_id") == ws).first()
    assert (job.status, job.total, job.processed, job.errors) == ("completed", len(files), len(files), 2)
    languages = {p: r.language for p, r in files.items()}
    assert languages["src/geo.h"] == "cpp" and languages["tool"] == "python" and languages["web/index.ts"] == "typescript" and languages["run.sh"] == "shell"
    assert files["data.bin"].is_binary and not files["run.sh"].is_binary
    assert counts == {"processed": len(files), "skipped": 0, "removed": 0}


def test_symbols_and_relations(spark, indexed):
    _, store, api, ws, _ = indexed
    symbols = store.table("symbol")
    by_name = ids(symbols, "qualified_name")
    assert {"Shape", "Shape.area", "helper", "Square", "Square.area", "run", "g::Box", "g::Box::size", "g::grow", "A", "A.go", "b", "greet"} <= set(by_name)
    edges = {(r.kind, r.source_symbol_id, r.target_symbol_id) for r in store.table("relation").collect()}
    assert ("contains", by_name["Shape"], by_name["Shape.area"]) in edges
    assert ("inherits", by_name["Square"], by_name["Shape"]) in edges
    assert ("overrides", by_name["Square.area"], by_name["Shape.area"]) in edges
    assert ("calls", by_name["Square.area"], by_name["helper"]) in edges
    assert ("calls", by_name["g::Box::size"], by_name["g::grow"]) in edges
    assert [r.name for r in api.callers(ws, by_name["helper"]).collect()] == ["area"]
    assert {r.qualified_name for r in api.callees(ws, by_name["run"]).collect()} >= {"Square"}


def test_dependencies(indexed):
    _, store, _, _, _ = indexed
    paths = {r.id: r.path for r in store.table("file").collect()}
    got = {(paths[r.source_file_id], r.raw_name): (paths.get(r.target_file_id), r.resolution) for r in store.table("dependency").collect()}
    assert got[("src/geo.cpp", "geo.h")] == ("src/geo.h", "resolved")
    assert got[("src/geo.cpp", "<vector>")] == (None, "external")
    assert got[("web/index.ts", "./lib/b")] == ("web/lib/b.ts", "resolved")
    assert got[("run.sh", "./lib.sh")] == ("lib.sh", "resolved")
    assert got[("app/main.py", "app.base.Shape")] == ("app/base.py", "resolved")
    assert got[("app/main.py", "os")] == (None, "external")


def test_resolution_states(indexed):
    _, store, _, _, _ = indexed
    rows = {(r.name, r.kind): r for r in store.table("occurrence").collect()}
    assert rows[("helper", "call")].resolution == "resolved" and rows[("helper", "call")].confidence == 0.9
    assert rows[("missing_thing", "call")].resolution == "unresolved"
    assert rows[("Shape", "inheritance")].resolution == "resolved"


def test_interface(indexed):
    _, store, api, ws, _ = indexed
    by_name = ids(store.table("symbol"), "qualified_name")
    files = ids(store.table("file"), "path")
    assert [(r.name, r.is_dir) for r in api.tree(ws).collect()][:2] == [("app", True), ("logs", True)]
    assert api.content(ws, files["app/base.py"], 0, 0).first().text == "class Shape:"
    assert api.content(ws, files["app/base.py"], None, None, 6, 11).first().text == "Shape"
    assert [(r.name, r.level) for r in api.outline(ws, files["app/base.py"]).filter("kind <> 'module'").collect()] == [("Shape", 0), ("area", 1), ("helper", 0)]
    assert api.symbol_at(ws, files["app/base.py"], 20).first().name == "Shape"
    assert api.search_source(ws, "shape").first().path.startswith("app/")
    assert "<b>" in api.search_source(ws, "shape").first().snippet
    assert api.search_symbols(ws, "helper").first().name == "helper"
    assert [r.bucket for r in api.unresolved_calls(ws, "missing").collect()] == [1]
    assert api.symbols(ws, kind="class", limit=1).first().has_more
    assert api.symbol(ws, by_name["helper"]).first().callers == 1
    assert api.summary(ws).first().files == store.table("file").filter("not is_deleted").count()
    assert {r.code for r in api.diagnostics(ws, "error").collect()} == {"syntax.error", "file.binary"}
    nodes, edges, cut = api.graph(ws, by_name["Square"], depth=2)
    assert by_name["Shape"] in {r.id for r in nodes.collect()} and not cut and edges.count()
    assert api.definitions(ws, by_name["helper"]).count() == 1
    assert api.references(ws, by_name["helper"]).count() >= 1
    lit = {(r.start_line, r.start_column): (r.length, schema.TOKEN_TYPES[r.token_type]) for r in api.highlights(ws, files["app/base.py"]).collect()}
    assert lit[(0, 0)] == (5, "keyword") and lit[(0, 6)] == (5, "class") and lit[(1, 4)] == (14, "string") and lit[(3, 15)] == (1, "number")
    other = api.create_workspace("o", "/o")
    assert api.symbols(other).count() == 0
    api.link(other, ws)
    assert api.symbols(other).count() > 0 and [r.target for r in api.links(other).collect()] == [ws] and [r.source for r in api.consumers(ws).collect()] == [other]
    api.unlink(other, ws)
    assert api.symbols(other).count() == 0
    api.log_job(ws, 1, "full", "running")
    api.log_job(ws, 1, "full", "completed", total=5)
    assert (api.jobs(ws).filter("id = 1").first().status, api.jobs(ws).filter("id = 1").first().total) == ("completed", 5)
    assert api.status(ws).first().status == "ready" and api.status(other).first().status == "idle"
    with pytest.raises(ValueError):
        api.link(ws, ws)


def test_incremental_run(spark, indexed, tmp_path):
    write(tmp_path, TREE)
    store = Store(spark, str(tmp_path / "store.d"))
    root = tmp_path / "t"
    write(root, {"a.py": "def f():\n    return g()\n", "b.py": "def g():\n    return 1\n", "c.py": "x = 1\n"})
    assert indexing.index(spark, store, str(root), 5)["processed"] == 3
    before = ids(store.table("symbol"), "qualified_name")
    assert indexing.index(spark, store, str(root), 5) == {"processed": 0, "skipped": 3, "removed": 0}
    (root / "b.py").write_text("def h():\n    return 1\n")
    (root / "c.py").unlink()
    assert indexing.index(spark, store, str(root), 5) == {"processed": 1, "skipped": 1, "removed": 1}
    after = ids(store.table("symbol"), "qualified_name")
    assert "h" in after and "g" not in after and "x" not in after and after["f"] == before["f"]
    assert {r.path for r in store.table("file").filter("is_deleted").collect()} == {"c.py"}
    store.delete_workspace(5)
    assert store.table("symbol").count() == 0


def test_linked_workspaces(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    api = Api(store)
    write(tmp_path / "sdk", {"inc/sdk.h": '#include "more.h"\nint start(int a);\n', "inc/more.h": "int more(int a);\n", "inc/hidden.h": "int hidden(int a);\n"})
    write(tmp_path / "app", {"main.c": '#include "inc/sdk.h"\nint main(void) { start(1); more(2); hidden(3); return 0; }\n'})
    sdk, app = api.create_workspace("sdk", "/sdk"), api.create_workspace("app", "/app")
    api.link(app, sdk)
    indexing.index(spark, store, str(tmp_path / "app"), app)
    calls = lambda: {r.name: r.resolution for r in store.table("occurrence").filter((F.col("workspace_id") == app) & (F.col("kind") == "call")).collect()}
    assert set(calls().values()) == {"unresolved"}
    indexing.index(spark, store, str(tmp_path / "sdk"), sdk)  # and the app, which links to it, anew
    assert calls() == {"start": "resolved", "more": "resolved", "hidden": "unresolved"}
    assert {(r.raw_name, r.reason) for r in store.table("dependency").filter(F.col("workspace_id") == app).collect()} == {("inc/sdk.h", f"workspace:{sdk}")}
    api.unlink(app, sdk)
    assert indexing.resolve_workspace(store, app)["resolved"] == 0


def test_links_and_unreadable_files(spark, tmp_path):
    root = tmp_path / "t"
    write(root, {"a/x.py": "x = 1\n", "b/y.py": "y = 1\n", "build/z.py": "z = 1\n", "big.py": "#" * 200})
    write(tmp_path / "out", {"secret.py": "s = 1\n"})
    for name, to in (("a/loop", root), ("A", root / "a"), ("outside", tmp_path / "out"), ("secret.py", tmp_path / "out/secret.py"), ("broken", root / "none"), ("made", root / "build"), ("y2.py", root / "b/y.py")):
        (root / name).symlink_to(to)
    got = {r.path: (r.error, r.content is None) for r in discovery.discover(spark, str(root), max_bytes=100).collect()}
    assert got == {"a/x.py": (None, False), "b/y.py": (None, False), "made/z.py": (None, False), "y2.py": (None, False), "big.py": ("file.too_large", True)}
    assert discovery.capture(str(root), "secret.py") == (None, "file.outside") and discovery.capture(str(root), "none.py") == (None, "file.unreadable")
    store = Store(spark, str(tmp_path / "store"))
    indexing.index(spark, store, str(root), 3)
    before = store.table("symbol").count()
    (root / "b/y.py").write_text("y = 1\n" * 50)  # now too large: what was known of it stays, with a diagnostic
    indexing.index(spark, store, str(root), 3, max_bytes=100)
    assert store.table("symbol").count() == before and store.table("file_content").filter("text like 'y%'").count() == 2
    assert {r.code for r in store.table("diagnostic").collect()} == {"file.too_large"}
    assert store.version() == 2  # one commit per run


def test_project_files(spark, tmp_path):
    root = tmp_path / "t"
    commands = [{"directory": str(root / "out"), "file": "../src/a.c", "command": f"cc -I../inc -isystem /usr/include -I{root}/sys a.c"}, {"directory": "/elsewhere", "file": "b.c", "arguments": ["cc"]}]
    script = {"compilerOptions": {"baseUrl": "web", "paths": {"@a/*": ["none/*", "lib/*"], "@a/deep/*": ["deep/*/main"], "whole": ["lib/b"]}}}
    write(root, {
        "compile_commands.json": json.dumps(commands), "tsconfig.json": json.dumps(script), "go.mod": "module example.org/m\n",
        "src/a.c": '#include "p.h"\n#include <q.h>\n', "inc/p.h": "", "sys/q.h": "", "other/q.h": "",
        "web/i.ts": "import { b } from '@a/b';\nimport { c } from '@a/deep/c';\nimport w from 'whole';\nimport x from '@b/b';\n", "web/lib/b.ts": "", "web/deep/c/main.ts": "",
        "main.go": 'package main\nimport "example.org/m/pkg"\n', "pkg/p.go": "package pkg\n",
        "Main.java": "import com.x.User;\nclass Main { }\n", "src/com/x/User.java": "package com.x;\nclass User { }\n",
    })
    found = projects.search_paths(projects.rebased(projects.compile_commands(spark, str(root / "compile_commands.json")), str(root)))
    assert [(r.file, r.paths) for r in found.collect()] == [("src/a.c", ["src", "inc", "sys"])]
    store = Store(spark, str(tmp_path / "store"))
    indexing.index(spark, store, str(root), 3)
    paths = {r.id: r.path for r in store.table("file").collect()}
    got = {r.raw_name: paths.get(r.target_file_id) for r in store.table("dependency").collect()}
    assert got == {"p.h": "inc/p.h", "<q.h>": "sys/q.h", "@a/b": "web/lib/b.ts", "@a/deep/c": "web/deep/c/main.ts", "whole": "web/lib/b.ts", "@b/b": None, "example.org/m/pkg": "pkg/p.go", "com.x.User": "src/com/x/User.java"}


def test_commits_of_two_writers(spark, tmp_path):
    link = lambda *p: spark.createDataFrame(list(p), schema.columns("workspace_link"))
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.append("workspace_link", link((1, 2)))
    two.version = lambda: 0  # as if it had begun before
    with pytest.raises(RuntimeError):
        two.append("workspace_link", link((8, 9)))
    assert [tuple(r) for r in one.table("workspace_link").collect()] == [(1, 2)]
    one.append("workspace_link", link((1, 3)))
    assert len(one.manifest()["workspace_link"]) == 2 and one.table("workspace_link").count() == 2
    at = one.version()
    changed = one.table("workspace_link", at).filter("target <> 2")
    one.upsert("workspace_link", link((4, 5)), ["source"])
    with pytest.raises(RuntimeError):
        one.commit({"workspace_link": changed}, base=at)
    assert sorted(map(tuple, one.table("workspace_link").collect())) == [(1, 2), (1, 3), (4, 5)]


def test_change_of_a_workspace(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    api = Api(store)
    ws = api.create_workspace("n", str(tmp_path / "t"))
    file = spark.createDataFrame([(1, ws, "a.py", "python", 6, None, "h", False, False)], schema.columns("file"))
    store.commit({"file": file}, ws)
    api.change_workspace(ws, name="m", include=["*.py"])
    assert [(r.name, r.include, r.revision) for r in api.workspace(ws).collect()] == [("m", ["*.py"], 1)]
    assert [r.content_hash for r in store.table("file").collect()] == [None]  # so the next run parses it anew
    assert api.status(ws).first().status == "idle"


@pytest.mark.parametrize(
    ("language", "text", "wanted"),
    [
        ("python", "def é(): # c\n  return 'a' + 1\n", ["keyword:0:0:3", "comment:0:10:3", "keyword:1:2:6", "string:1:9:3", "operator:1:13:1", "number:1:15:1"]),
        ("c", "#define X 1\n/* a\nb */ int x = 2;", ["macro:0:0:11", "comment:1:0:4", "comment:2:0:4", "keyword:2:5:3", "operator:2:11:1", "number:2:13:1"]),
        ("javascript", "let r = /a\"b/g; // z", ["keyword:0:0:3", "operator:0:6:1", "regexp:0:8:6", "comment:0:16:4"]),
        ("bash", "# c\nif a; then echo $# \"x\"; fi", ["comment:0:0:3", "keyword:1:0:2", "keyword:1:6:4", "string:1:19:3", "keyword:1:24:2"]),
        ("unknown", "if", []),
    ],
)
def test_lexical_highlights(language, text, wanted):
    assert [f"{kind}:{line}:{column}:{size}" for line, column, size, kind in highlight.tokens(text, language)] == wanted


def test_csharp_names(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write(tmp_path / "t", {"a.cs": "namespace N.Sub {\n class Tool {\n  public void Go() { }\n }\n}\n", "b.cs": "using N.Sub;\nusing Other = M.Thing;\nnamespace P {\n class Q : Tool {\n }\n class R : Other {\n }\n class S : Q {\n }\n}\n", "c.cs": "namespace M {\n class Thing {\n }\n}\nnamespace P {\n class T : Q {\n }\n}\n"})
    indexing.index(spark, store, str(tmp_path / "t"), 3)
    names = {r.id: r.qualified_name for r in store.table("symbol").collect()}
    got = {(r.scope, r.name): (names.get(r.symbol_id), r.resolution) for r in store.table("occurrence").filter("kind in ('inheritance', 'implementation')").collect()}
    assert got == {("P.Q", "Tool"): ("N.Sub.Tool", "resolved"), ("P.R", "Other"): ("M.Thing", "resolved"), ("P.S", "Q"): ("P.Q", "resolved"), ("P.T", "Q"): ("P.Q", "resolved")}


def test_csharp_usings(spark, tmp_path):
    """Static and global usings, and names that begin with an alias."""
    store = Store(spark, str(tmp_path / "store"))
    write(tmp_path / "t", {
        "lib.cs": "namespace N.Math {\n class Calc {\n  public static int Twice(int a) { return a; }\n }\n}\nnamespace G {\n class Shared { }\n}\n",
        "global.cs": "global using G;\n",
        "use.cs": "using static N.Math.Calc;\nusing M = N.Math;\nnamespace P {\n class Q : M.Calc {\n  int Run() { return Twice(2); }\n }\n class S : Shared { }\n}\n",
        "other.cs": "namespace R {\n class Z {\n  int Run() { return Thrice(2); }\n }\n class Y : M.Calc { }\n}\n",
    })
    indexing.index(spark, store, str(tmp_path / "t"), 3)
    names = {r.id: r.qualified_name for r in store.table("symbol").collect()}
    got = {(r.scope, r.name): names.get(r.symbol_id) for r in store.table("occurrence").filter("kind in ('inheritance', 'implementation', 'call')").collect()}
    assert got["P.Q.Run", "Twice"] == "N.Math.Calc.Twice" and got["P.S", "Shared"] == "G.Shared" and got["P.Q", "M.Calc"] == "N.Math.Calc"
    assert got["R.Z.Run", "Thrice"] is None and got["R.Y", "M.Calc"] is None  # the alias is another file's


def test_python_facts():
    f = py.extract("import a.b as c\n@deco\ndef é(x, *, y=1):\n    return self.z(x)\n", "p/m.py")
    names = [(s["qualified_name"], s["kind"]) for s in f.symbols]
    assert names == [("m", "module"), ("c", "type_alias"), ("é", "function")]
    e = f.symbols[2]
    assert f.raw[e["start_byte"] : e["end_byte"]].decode() == "é" and e["signature"] == "(x, *, y=1)"
    assert ("z", "call", 0.9) in {(o["name"], o["kind"], o["confidence"]) for o in f.occurrences}
    assert json.loads(next(o for o in f.occurrences if o["name"] == "deco")["metadata"]) == {"is_decorator": True}


@pytest.mark.parametrize(("language", "text", "symbols", "calls"), [
    ("c", "#define N 1\nstruct P { int x; };\nint add(int a, int b);\nint add(int a, int b) { /* no(); */ return mul(a, b); }\n", {"P", "add", "N"}, {("mul", 2)}),
    ("go", 'package m\nimport "fmt"\ntype T struct { x int }\nfunc (t *T) Do(a int) int { return help(a) }\n', {"m", "m.T", "m.T.x", "m.T.Do"}, {("help", 1)}),
    ("java", "package p;\nimport java.util.List;\npublic class A extends B implements C {\n  public int f(int x) { return g(x, \"h()\"); }\n}\n", {"A", "A.f"}, {("g", 2)}),
    ("csharp", "using System;\nnamespace N {\n class A : B, IC {\n  public void F() { G(); }\n }\n}\n", {"N", "N.A", "N.A.F"}, {("G", 0)}),
    ("javascript", "const r = require('x');\nfunction f(a) { return r(a, [1, 2]); }\n", {"f", "r"}, {("r", 2), ("require", 1)}),
])
def test_scanned_facts(language, text, symbols, calls):
    f = scanner.extractor(language)(text, "x")
    assert symbols <= {s["qualified_name"] for s in f.symbols}
    assert calls <= {(o["name"], o["arity"]) for o in f.occurrences if o["kind"] == "call"}
    assert not any(o["name"] in ("no", "h") for o in f.occurrences)
    for s in f.symbols:
        assert f.raw[s["start_byte"] : s["end_byte"]].decode() == s["name"]


#: Written for this test: each language's text, what it declares as kind and qualified name, and what it calls.
SOURCES = {
    "c": (
        "#include <a.h>\n#define CAP 8\n#define TWICE(x) ((x) + (x))\ntypedef unsigned long word_t;\ntypedef struct { int w; } box_t;\nenum tone { LOW, HIGH = 3 };\nunion cell { int i; char c[4]; };\n"
        "extern int total;\nstatic const int first = 1, *second = 0;\nint (*hook)(int);\nstruct cell_list *grow(struct cell_list *l, int n);\nstatic int run(int n) {\n  int k = TWICE(n);\n  for (int i = 0; i < n && k > 0; i++) { step(i, k); }\n  return k;\n}\n",
        "macro CAP, macro TWICE, type_alias word_t, type_alias box_t, enum tone, enum_member tone::LOW, enum_member tone::HIGH, struct cell, field cell::i, field cell::c, variable total, variable first, variable second, variable hook, function grow, function run, variable run::k",
        "TWICE step",
    ),
    "cpp": (
        "#include <vector>\nnamespace a::b {\ntemplate <typename T> class Pile : public Base<T>, private Other {\npublic:\n  explicit Pile(int n) : size_(n), items_{} {}\n  virtual ~Pile() = default;\n  bool operator==(const Pile& o) const;\n  T pop() const override { return items_.back(); }\n"
        "private:\n  std::vector<T> items_;\n  int size_ = 0;\n};\nenum class Tone : int { Low, High };\nusing Name = std::string;\ntemplate <typename T> T Pile<T>::top() { return peek(); }\n}\nnamespace { int hidden; }\nvoid go() {\n  auto f = [](int x) { return twice(x); };\n  a::b::Pile<int> p(3);\n  p.pop();\n}\n",
        "namespace a::b, class a::b::Pile, method a::b::Pile::Pile, method a::b::Pile::~Pile, method a::b::Pile::pop, field a::b::Pile::items_, field a::b::Pile::size_, enum a::b::Tone, enum_member a::b::Tone::Low, enum_member a::b::Tone::High, type_alias a::b::Name, method a::b::Pile::top, variable hidden, function go, variable go::f, variable go::p",
        "back peek twice pop",
    ),
    "csharp": (
        "using System;\nnamespace Shop.Core {\npublic enum Tone { Low, High }\npublic interface ICart<T> where T : class { int Count { get; } void Add(T item); }\n[Serializable]\npublic sealed class Cart : Base, ICart<Item> {\n  private readonly List<Item> _items = new List<Item>();\n  public int Count => _items.Count;\n  public string Name { get; set; } = \"x\";\n"
        "  public Cart(int n) : base(n) { Reset(); }\n  public void Add(Item item) { if (item != null) { _items.Add(item); } }\n  public async Task<int> Sum<T>(Func<T, int> f) { return f(default); }\n}\n}\n",
        "namespace Shop.Core, enum Shop.Core.Tone, enum_member Shop.Core.Tone.Low, enum_member Shop.Core.Tone.High, interface Shop.Core.ICart, field Shop.Core.ICart.Count, method Shop.Core.ICart.Add, class Shop.Core.Cart, field Shop.Core.Cart._items, field Shop.Core.Cart.Count, field Shop.Core.Cart.Name, method Shop.Core.Cart.Cart, method Shop.Core.Cart.Add, method Shop.Core.Cart.Sum",
        "List Reset Add f",
    ),
    "java": (
        "package p.q;\nimport java.util.List;\n@Deprecated\npublic enum Tone implements Named { LOW(1), HIGH(2) { int x() { return 1; } }; private final int v; Tone(int v) { this.v = v; } }\npublic abstract class Bag<T extends Comparable<T>> extends Base implements Named, Sized {\n  protected List<T> items = new ArrayList<>();\n  private int[] sizes;\n"
        "  public Bag() { super(); clear(); }\n  @Override public <R> R fold(R start, Fn<R> f) { for (T t : items) { start = f.apply(start); } return start; }\n  abstract int weigh(T item);\n  static class Inner { Runnable r = () -> { run(); }; }\n  interface Sink { void take(int a, String b); }\n}\n",
        "package p.q, enum Tone, enum_member Tone.LOW, enum_member Tone.HIGH, field Tone.v, method Tone.Tone, class Bag, field Bag.items, field Bag.sizes, method Bag.Bag, method Bag.fold, method Bag.weigh, class Bag.Inner, field Bag.Inner.r, interface Bag.Sink, method Bag.Sink.take",
        "ArrayList clear apply run",
    ),
    "javascript": (
        "import dflt, { a as b } from './m';\nimport * as ns from 'n'\nexport { helper as tool } from './t'\nconst fs = require('fs'), { join, sep: bar } = require('path');\nlet n = 1\nexport default async function main(x, { y } = {}) {\n  const again = (z) => {\n    ping(z)\n  }\n  return again(x) / 2 // '\n}\n"
        "const add = (p, q) => p + q\nclass Box extends Base {\n  #hidden = 1;\n  static make() { return new Box() }\n  get size() { return this.count(); }\n}\nBox.prototype.shake = function (k) { rattle(k); };\nconst re = /[/'\"]{2}/g;\nfs.on('x', function () { done(); });\n",
        "variable dflt, type_alias b, namespace ns, type_alias tool, variable fs, variable join, variable bar, variable n, function main, function main.again, function add, class Box, method Box.make, method Box.size, method Box.shake, variable re",
        "require ping again Box count rattle on done",
    ),
    "typescript": (
        "export type Id = string | { a: number };\nexport enum Tone { Low = 1, High }\nexport interface Sink<T> extends Base {\n  name: string;\n  take(item: T): void;\n  onDone?: () => void;\n}\nabstract class Pipe<T> implements Sink<T>, Other {\n  private items: Map<string, T> = new Map();\n  constructor(readonly id: Id) { super(id); open(id); }\n"
        "  abstract flush(): void;\n  async take(item: T): Promise<void> { await this.push<T>(item); }\n}\nnamespace Util { export function f(x?: number): number { return g(x!); } }\nexport const View = (p: { label: string }) => { return <Panel.Head label={p.label}><Row /></Panel.Head>; };\n",
        "type_alias Id, enum Tone, enum_member Tone.Low, enum_member Tone.High, interface Sink, field Sink.name, method Sink.take, field Sink.onDone, class Pipe, variable Pipe.items, method Pipe.constructor, method Pipe.flush, method Pipe.take, namespace Util, function Util.f, function View",
        "Map open push g Panel.Head Row",
    ),
    "go": (
        "package store\n\nimport (\n\t\"fmt\"\n\tio2 \"io\"\n)\n\nconst (\n\tMax = 3\n\tMin\n)\n\nvar cache, spare map[string]int\n\ntype ID = string\ntype Table struct {\n\tBase\n\tName, Label string\n\trows []Row `json:\"rows\"`\n}\n\ntype Reader interface {\n\tio2.Closer\n\tRead(n int) (int, error)\n}\n\n"
        "func (t *Table) Get(k string) (r Row, err error) {\n\tif v := find(k); v > 0 {\n\t\treturn t.rows[v], nil\n\t}\n\trow := Row{Name: k}\n\tdefer func() { done() }()\n\treturn row, fmt.Errorf(\"x\")\n}\n\nfunc Map[T any](xs []T, f func(T) T) []T { return f(xs[0]) }\n",
        "package store, variable store.Max, variable store.Min, variable store.cache, variable store.spare, type_alias store.ID, struct store.Table, field store.Table.Name, field store.Table.Label, field store.Table.rows, interface store.Reader, method store.Reader.Read, method store.Table.Get, function store.Map",
        "find done Errorf f",
    ),
    "shell": (
        "#!/bin/sh\n. ./lib.sh\nsource \"$HOME/rc\"\nNAME=one OTHER=\"two $(whoami)\"\nexport PATH_X=/a:/b\nalias ll='ls -l'\nbuild() {\n  local out=$1\n  if [ -f \"$out\" ]; then\n    make all && notify done # not this\n  fi\n  for f in a b; do cp \"$f\" /tmp; done\n}\nfunction clean { rm -rf out; }\ncat <<EOF\nnot_a_command\nEOF\nbuild | tee log\nclean\n",
        "variable NAME, variable OTHER, variable PATH_X, macro ll, function build, variable build.out, function clean",
        "whoami make notify cp rm cat build tee clean",
    ),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_declarations_and_calls(language):
    text, declared, called = SOURCES[language]
    f = scanner.extractor(language)(text, "x.tsx" if language == "typescript" else "x")
    symbols = [f"{s['kind']} {s['qualified_name']}" for s in f.symbols]
    calls = [o["name"] for o in f.occurrences if o["kind"] == "call"]
    wanted = declared.split(", ")
    assert [w for w in wanted if w not in symbols] == []
    assert len(set(symbols) - set(wanted)) <= 2, set(symbols) - set(wanted)
    assert [c for c in called.split() if c not in calls] == []
    assert len(set(calls) - set(called.split())) <= 2, set(calls) - set(called.split())
    assert not f.diagnostics
    for s in f.symbols:
        assert f.raw[s["start_byte"] : s["end_byte"]].decode() == s["name"] and s["body_start"] <= s["start_byte"] < s["body_end"]


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_odd_text_takes_linear_time(language):
    import time

    took = time.thread_time()
    for text in (" && ".join(f"a{i}" for i in range(5000)), "a*" * 5000, "f(" * 3000, "{" * 5000, "a<" * 3000, "x = " * 5000, "((((" * 2000 + "))))" * 2000, '"' * 999, "/*" * 999, "a b " * 5000 + ";"):
        scanner.extractor(language)(text + "\n", "x")
    assert time.thread_time() - took < 20
    short = time.thread_time()
    scanner.extractor(language)("x = " + " && ".join(f"a{i}" for i in range(5000)) + ";\n", "x")
    assert time.thread_time() - short < 2


def test_ignore_rules_and_globs(spark):
    rules = discovery.ignore_rules("*.log\n!keep.log\n/top\nsub/x\nonly/\n", "") + discovery.ignore_rules("*.txt\n", "docs")
    names = ["a.log", "d/a.log", "keep.log", "top", "d/top", "sub/x/y", "d/sub/x", "only/a", "d/only/b", "only", "docs/a.txt", "a.txt"]
    got = {r.p for r in spark.createDataFrame([(n,) for n in names], "p string").filter(discovery.ignored(F.col("p"), rules)).collect()}
    assert got == {"a.log", "d/a.log", "top", "sub/x/y", "only/a", "d/only/b", "docs/a.txt"}
    df = spark.createDataFrame([("a/b.py",), ("b.py",), ("a/c/d.py",), ("a/x.js",)], "p string")
    assert {r.p for r in df.filter(discovery.included(F.col("p"), ["a/**/*.py"], ["**/c/**"])).collect()} == {"a/b.py"}


def test_binary_sniff(spark):
    rows = [(b"ab\x00c",), (b"a\x10\x02b",), ("é".encode(),), (b"\xff\xfe",), (b"",)]
    assert [r.b for r in spark.createDataFrame(rows, "c binary").select(discovery.is_binary(F.col("c")).alias("b")).collect()] == [True, False, False, True, False]


def test_compile_commands(spark, tmp_path):
    p = tmp_path / "compile_commands.json"
    p.write_text(json.dumps([{"directory": "/w", "file": "src/a.c", "command": "cc -Iinc -isystem sys -DX=1 -DY -UX -std=c11 'a b.c' -o out.o"}, {"directory": "/w", "file": "src/b.c", "arguments": ["cc", "-iquote", "q", "-I", "inc", "-Iinc"]}]))
    contexts = projects.compile_commands(spark, str(p))
    assert {r.file: r.paths for r in projects.search_paths(contexts).collect()} == {"src/a.c": ["src", "inc", "sys"], "src/b.c": ["src", "q", "inc"]}
    assert {(r.file, r.name, r.value) for r in projects.macro_values(contexts).collect()} == {("src/a.c", "Y", "1")}
    assert projects.split_command("cc 'open") == ["cc", "'open"]
    (tmp_path / "go.mod").write_text("// c\nmodule example.org/m\ngo 1.2\n")
    assert projects.go_module(spark, str(tmp_path / "go.mod")) == "example.org/m"
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["a/*", "b/*"], "@a/long/*": ["c/*"]}}}')
    assert [(r.pattern, r.target) for r in projects.path_maps(spark, str(tmp_path / "tsconfig.json")).collect()] == [("@a/long/*", "c/*"), ("@a/*", "a/*"), ("@a/*", "b/*")]


def test_relative_paths(spark):
    rows = [("a/b", "../c"), ("a", "../../c"), ("", "./x"), ("a/b", "./c/../d")]
    got = [r.j for r in spark.createDataFrame(rows, "b string, n string").select(dependencies.joined(F.col("b"), F.col("n")).alias("j")).collect()]
    assert got == ["a/c", None, "x", "a/b/d"]


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.version() == 0 and store.table("workspace_link").count() == 0
    link = lambda *p: spark.createDataFrame(list(p), schema.columns("workspace_link"))
    store.append("workspace_link", link((1, 2), (1, 3)))
    store.insert_missing("workspace_link", link((1, 2), (2, 3)), ["source", "target"])
    assert store.version() == 2 and sorted(map(tuple, store.table("workspace_link").collect())) == [(1, 2), (1, 3), (2, 3)]
    store.upsert("workspace_link", link((1, 9)), ["source"])
    assert sorted(map(tuple, store.table("workspace_link").collect())) == [(1, 9), (2, 3)]
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, s int")
    assert sorted((r.k, r.v) for r in last_wins(rows, ["k"], "s").collect()) == [(1, "b"), (2, "c")]


def test_files_without_extractor_or_text(spark):
    files = spark.createDataFrame([(1, 1, "a.py", "python", "def f(): pass"), (2, 1, "b.txt", "unknown", "zz"), (3, 1, "c.py", "python", None)], "file_id long, workspace_id long, path string, language string, text string")
    facts = extract.extract_facts(files)
    assert extract.symbols(facts).filter("kind = 'function'").count() == 1 and extract.occurrences(facts).count() == 0


def test_python_names_in_scopes():
    f = py.extract("from math import sqrt as root\n\nclass A:\n    kind = 1\n\n    def f(self, x):\n        y = root(x)\n        return y\n", "m.py")
    assert [(s["qualified_name"], s["kind"]) for s in f.symbols] == [("m", "module"), ("root", "type_alias"), ("A", "class"), ("A.kind", "variable"), ("A.f", "method")]
    uses = [(o["name"], o["kind"]) for o in f.occurrences]
    assert ("sqrt", "import") in uses and ("y", "reference") in uses and ("root", "call") in uses
    assert json.loads(f.occurrences[0]["metadata"]) == {"module": "math", "path": "math.sqrt"}


def test_language_settings(spark):
    rows = [("a.h", b"int x;"), ("b", b"#!/usr/bin/env -S python3.11 -u\n"), ("c", b"#!/bin/dash\n"), ("d", b"text"), ("e.x", b"#! /usr/bin/node\n"), ("f.weird", b""), ("g.tpp", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    language = lambda **k: {r.path: r.language for r in discovery.with_language(df, **k).collect()}
    assert language() == {"a.h": "c", "b": "python", "c": "shell", "d": "unknown", "e.x": "javascript", "f.weird": "unknown", "g.tpp": "cpp"}
    got = language(headers="cpp", extensionless="cpp", overrides={".weird": "go", "d": "java"})
    assert got["a.h"] == "cpp" and got["d"] == "java" and got["f.weird"] == "go" and got["c"] == "shell"
