"""Layers, the stored full-text and trigram indexes, stored listings, and jobs."""

import random
import threading
import time
from contextlib import contextmanager

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight import schema
from quarrylight.api import Api
from quarrylight.operators import paging, search
from quarrylight.plans import indexing, searching
from quarrylight.sources import fulltext, jobs, layers
from quarrylight.sources.fulltext import TextIndex
from quarrylight.sources.grams import GramIndex, needed
from quarrylight.sources.layers import Layers
from quarrylight.sources.manifest import Manifests
from quarrylight.sources.store import Store


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_layers_equal_a_rewritten_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "BUCKET_ROWS", 20)
    rnd = random.Random(2)
    table = Layers(Manifests(spark, str(tmp_path)), str(tmp_path), "k bigint, v string, w array<int>", "k", order=["k", "v"])
    rows = lambda held: spark.createDataFrame([(k, v, [len(v)]) for k, vs in held.items() for v in vs], table.columns)
    held, parts = {i: [f"v{j}" for j in range(i % 4)] for i in range(60)} | {None: ["null"]}, []
    for step in range(6):
        parts = table.replace(parts, rows(held), f"d{step}", step + 1)
        assert plain(table.visible(parts)) == plain(rows(held))
        for _ in range(3):
            k = rnd.choice([*range(60), None])
            held[k] = rnd.choice([[], ["new"], [f"x{step}", "x", "x"], held.get(k, [])])
    assert 1 < len(parts) < 6  # the last ones have been merged
    assert plain(table.visible(parts, [7, 9])) == plain(table.visible(parts).filter("k in (7, 9)"))
    scan = table.read(parts[0], [7])._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_change_costs_bytes_in_proportion(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    text = lambda changed: spark.range(10_000).select(F.col("id").alias("file_id"), F.lit(4).cast("long").alias("workspace_id"), F.concat(F.repeat(F.sha2(F.concat("id", F.lit(":x")), 256), 20), F.when(F.col("id") == changed, "changed").otherwise("")).alias("text"))
    store.commit({"file_content": text(-1)}, 4)
    before, size = store.table("file_content"), store.manifests.size(f"{tmp_path}/data")
    at = store.version()
    store.commit({"file_content": text(77)}, 4)
    assert store.manifests.size(f"{tmp_path}/data") - size < size / 100
    assert before.filter("text like '%changed'").count() == 0 == store.table("file_content", at).filter("text like '%changed'").count()
    assert [r.file_id for r in store.table("file_content").filter("text like '%changed'").collect()] == [77]
    assert store.table("file_content").count() == 10_000 and plain(store.table("file_content", keys=[77]).select("file_id")) == [(77,)]
    store.commit({"file_content": text(77)}, 4)
    assert len(store.manifest()["file_content"]["4"]) == 2  # nothing differs, nothing is written
    store.delete_workspace(4)
    assert store.table("file_content").count() == 0 and store.table("file_content", at).count() == 10_000


def test_only_the_asked_workspaces_are_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda ws: spark.createDataFrame([(ws * 10, ws, f"text {ws}")], schema.columns("file_content"))
    store.commit({"file_content": row(1).unionByName(row(2))})  # of all workspaces, undivided
    for ws in (2, 3, 4):
        store.commit({"file_content": row(ws)}, ws)
    assert [r.workspace_id for r in store.table("file_content").orderBy("workspace_id").collect()] == [1, 2, 3, 4]
    assert [r.text for r in store.table("file_content", workspaces=[3]).collect()] == ["text 3"]
    files = store.table("file_content", workspaces=[3]).inputFiles()
    assert not any("/file_content/2/" in f or "/file_content/4/" in f for f in files)


DOCS = {1: "the version one", 2: "The Apache License, version 2", 3: "un café à la carte", 4: None, 5: "", 6: "the the the end", 7: "version the", 8: "licensed under the apache licence"}
QUERIES = ["the version", "the OR license", '"the version"', "apa*", '"apache lic"*', "the NOT version", "cafe", "(version OR end) AND the", "nothing", "", "the the", '"version the" OR carte', "lic* NOT (apache OR x)"]


@pytest.mark.parametrize("folded", [False, True])
def test_index_ranks_as_the_texts_do(spark, tmp_path, folded, monkeypatch):
    monkeypatch.setattr(layers, "BUCKET_ROWS", 5)
    frame = lambda docs: spark.createDataFrame(list(docs.items()), "id long, text string")
    index = TextIndex(spark, str(tmp_path), ["text"], folded)
    index.commit(frame(DOCS), "id")
    now = dict(DOCS)
    for change, gone in (({7: "another text the version", 9: "the end"}, [1]), ({2: None, 3: "la la land"}, [6, 40]), ({}, [8]), ({8: "back version the"}, []), ({1: "the version one again"}, [9])):
        index.commit(frame(change) if change else frame(DOCS).limit(0), "id", spark.createDataFrame([(g,) for g in gone], "id long"))
        now = {k: v for k, v in (now | change).items() if k not in gone}
    state = index.state()
    lengths = [len(search.words_of(t or "")) for t in now.values()]
    assert (state["n"], state["words"]) == (sum(n > 0 for n in lengths), sum(lengths))
    for q in QUERIES:
        assert plain(index.search(q)) == plain(search.search(frame(now), q, "id", ["text"], folded)), q
    assert plain(index.search("the version", version=1)) == plain(search.search(frame(DOCS), "the version", "id", ["text"], folded))


def test_index_of_columns_and_of_several(spark, tmp_path):
    rows = [(1, "alpha beta", "gamma"), (2, "gamma", "alpha beta"), (3, None, "beta alpha"), (4, "alpha", "beta gamma")]
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    whole = TextIndex(spark, str(tmp_path / "w"), ["a", "b"])
    whole.commit(frame, "id")
    one, two = (TextIndex(spark, str(tmp_path / n), ["a", "b"]) for n in "xy")
    one.commit(frame.filter("id < 3"), "id")
    two.commit(frame.filter("id >= 3"), "id")
    from quarrylight.sources import fulltext

    for q in ("alpha", "a:alpha", "b:alpha NOT a:gamma", 'b:"beta gamma"', "a:al* OR b:be*", '"beta gamma"', "b:(alpha)"):
        wanted = plain(search.search(frame, q, "id", ["a", "b"]))
        assert plain(whole.search(q)) == wanted == plain(fulltext.search([one, two], q)), q


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "BUCKET_ROWS", 100)
    docs = spark.range(400).select("id", F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(200))) for i in range(10))).alias("text"))
    index = TextIndex(spark, str(tmp_path), ["text"])
    index.commit(docs, "id")
    segment = index.state()["postings"][0]
    assert segment["buckets"] >= 30
    read = index.found(["w7"])
    assert "PartitionFilters: [" in read._jdf.queryExecution().toString() and len({f.split("_bucket=")[1].split("/")[0] for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) == 1
    size = index.manifests.size(f"{tmp_path}/segments")
    index.commit(docs.filter("id = 3"), "id")
    assert index.manifests.size(f"{tmp_path}/segments") - size < size / 4


def test_index_follows_the_store(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for name, text in {"a.py": "def alpha():\n    return 'searchable words'\n", "b.py": "def beta():\n    return alpha()\n"}.items():
        (root / name).write_text(text)
    store = Store(spark, str(tmp_path / "store"))
    api = Api(store)
    ws = api.create_workspace("w", str(root))
    indexing.index(spark, store, str(root), ws)
    paths = lambda q: [r.path for r in api.search_source(ws, q).collect()]
    names = lambda q: [r.name for r in api.search_symbols(ws, q).collect()]
    assert paths("searchable") == ["a.py"] and names("beta") == ["beta"]
    (root / "b.py").write_text("def gamma():\n    return 'searchable too'\n")
    indexing.index(spark, store, str(root), ws)
    index = searching.text_index(store, "file_content", ws)
    assert len(index.state()["postings"]) == 2 and index.state()["note"] == store.manifest()["file_content"][str(ws)]
    assert sorted(paths("searchable")) == ["a.py", "b.py"] and names("beta") == [] and names("gamma") == ["gamma"]
    assert searching.refresh(store, ws) == {}
    store.commit({"file_content": store.table("file_content", workspaces=[ws]).filter("text like '%too%'")}, ws)
    assert paths("searchable") == ["b.py"]  # the index is behind, so the texts are read
    assert searching.refresh(store, ws) == {"file_content": 1} and paths("searchable") == ["b.py"]


@pytest.mark.parametrize(("pattern", "wanted"), [("abcd", ["abc", "bcd"]), ("a%bcd_ef", ["bcd"]), ("ab", []), ("", []), ("A\\%BC", ["%bc", "a%b"])])
def test_trigrams_of_patterns(pattern, wanted):
    assert needed(pattern) == wanted


def test_names_by_trigrams(spark, tmp_path):
    names = [(1, "ReadFile"), (2, "readLine"), (3, "write_file"), (4, "fi"), (5, None), (6, "profiler"), (7, "FILE"), (8, "a%b"), (9, "élan FILÉ")]
    frame = spark.createDataFrame(names, "id long, name string")
    index = GramIndex(spark, str(tmp_path))
    index.commit(frame, "id", "name")
    for pattern in ("file", "FIL", "r%file", "r_ad", "fi", "", "zzz", "file zzz", "é", "FILÉ", "ead%ine"):
        assert plain(index.containing(frame, pattern, "id", "name")) == plain(frame.filter(F.col("name").ilike(f"%{pattern}%"))), pattern
    changed = spark.createDataFrame([(1, "WriteAll"), (10, "refile")], "id long, name string")
    index.commit(changed, "id", "name", spark.createDataFrame([(3,)], "id long"))
    after = frame.filter("id not in (1, 3)").unionByName(changed)
    assert plain(index.containing(after, "file", "id", "name")) == plain(after.filter("name ilike '%file%'"))
    assert index.candidates("file").count() == 3  # of those that are there now


def test_stored_listing(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(20)]), i, f"v{i}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "a int, b long, `c d` string").repartition(5)
    order = [("a", False), ("b", True)]
    stored = paging.listing(frame, order, str(tmp_path / "l"), 100)
    sort = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for offset, limit in ((0, 10), (95, 10), (500, 200), (990, 50), (1000, 5), (5000, 5)):
        got = stored.page(limit, offset).collect()
        assert [tuple(r)[:3] for r in got] == sort[offset : offset + limit]
        assert all((r.total, r.has_more) == (1000, offset + limit < 1000) for r in got)
    for at in (0, 400, 970, 999):
        assert [tuple(r) for r in stored.after(sort[at][:2], 30).collect()] == sort[at + 1 : at + 31]
    assert len({f.split("_run=")[1].split("/")[0] for f in stored.page(10, 500).inputFiles()}) <= 10 and sum(stored.counts) == 1000
    plan = stored.page(10, 500)._jdf.queryExecution().executedPlan().toString()
    assert "_run" in plan.split("PartitionFilters: [")[1].split("]")[0]
    empty = paging.listing(frame.limit(0), order, str(tmp_path / "e"))
    assert empty.page(10, 0).collect() == []


def slow_tree(root, n=60):
    root.mkdir(parents=True)
    for i in range(n):
        (root / f"m{i}.py").write_text("".join(f"def f{i}_{j}(a):\n    return f{(i + 1) % n}_{j}(a) + missing{j}(a)\n" for j in range(40)))


def test_a_run_is_cancelled(spark, tmp_path):
    slow_tree(tmp_path / "t")
    store = Store(spark, str(tmp_path / "store"))
    api = Api(store)
    ws = api.create_workspace("w", str(tmp_path / "t"))
    version, ended = store.version(), {}

    def work():
        try:
            indexing.index(spark, Store(spark, str(tmp_path / "store")), str(tmp_path / "t"), ws, job=99)
        except Exception as error:  # noqa: BLE001
            ended["error"] = error
        ended["at"] = time.time()

    thread = threading.Thread(target=work)
    thread.start()
    until = time.time() + 60
    while not api.job_history(ws, 99).filter("stage = 'extracting'").count() and time.time() < until:
        time.sleep(0.2)
    assert api.status(ws).first().status == "indexing"
    asked = time.time()
    assert api.cancel(ws, 99)
    thread.join(60)
    assert isinstance(ended["error"], jobs.Cancelled) and ended["at"] - asked < 5
    states = [r.status for r in api.job_history(ws, 99).collect()]
    assert states[0] == "queued" and "running" in states and states[-2:] == ["cancelling", "cancelled"]
    assert store.version() == version and api.job(ws, 99).first().status == "cancelled" and not api.cancel(ws, 99)
    assert not api.cancel(ws, 12345)


def test_states_of_runs(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.py").write_text("x = 1\n")
    store = Store(spark, str(tmp_path / "store"))
    api = Api(store)
    ws = api.create_workspace("w", str(tmp_path / "t"))
    indexing.index(spark, store, str(tmp_path / "t"), ws, job=5)
    history = api.job_history(ws, 5).collect()
    assert [(r.status, r.stage) for r in history] == [("queued", None), *(("running", s) for s in ("discovering", "planning", "extracting", "resolving", "writing")), ("completed", None)]
    assert history[-1].processed == 1 and api.status(ws).first().status == "ready" and not api.cancel(ws, 5)
    with pytest.raises(Exception):
        indexing.index(spark, store, str(tmp_path / "none"), ws, job=6, languages=object())
    assert api.job(ws, 6).first().status == "failed" and api.status(ws).first().status == "error"


def test_changes_of_workspaces_meet_other_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    api = Api(store)
    a, b, c = (api.create_workspace(n, f"/{n}") for n in "abc")
    api.link(a, b)
    at, real = store.version(), store.version
    api.link(a, c)
    for change in (lambda: api.unlink(a, b), lambda: api.change_workspace(a, name="x", include=["*.py"]), lambda: store.delete_workspace(b)):
        store.version = lambda: at  # as if it had read before the other commit
        with pytest.raises(RuntimeError):
            change()
        store.version = real
    assert sorted(r.target for r in api.links(a).collect()) == sorted([b, c])
    before = store.version()
    api.change_workspace(a, name="x", include=["*.py"])
    assert store.version() == before + 1


def test_compile_command_of_a_file(spark, tmp_path):
    (tmp_path / "compile_commands.json").write_text('[{"directory": "%s", "file": "a.c", "command": "cc -Iinc -DX=2 -std=c11 -c a.c"}]' % tmp_path)
    api = Api(Store(spark, str(tmp_path / "store")))
    ws = api.create_workspace("w", str(tmp_path))
    row = api.compile_command(ws, "a.c").first()
    assert (row.include, row.standard, [m.name for m in row.macros]) == (["inc"], "c11", ["X"])
    assert api.compile_command(ws, "b.c").count() == 0


def test_commit_keeps_numbers_only_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    kept, real = [], fulltext.holding

    @contextmanager
    def watched():
        with real() as keep:
            yield lambda df: kept.append(df.dtypes) or keep(df)

    monkeypatch.setattr(fulltext, "holding", watched)
    monkeypatch.setattr(fulltext, "BATCH", 10)
    index = fulltext.TextIndex(spark, str(tmp_path), ["a", "b"])
    index.commit(spark.createDataFrame([(i, f"x y z w{i}", "x u v") for i in range(50)] + [(60, None, "--"), (61, "", "x x")], "id long, a string, b string"), "id")
    assert kept and not [kind for dtypes in kept for name, kind in dtypes if "string" in kind or name == "places"]
    state = index.state()
    assert (state["n"], state["words"], sum(x["rows"] for x in state["postings"])) == (51, 352, 301)
    assert index.postings.visible(state["postings"]).count() == 301
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array([[f"t{i}" for i in range(d * 5)] for d in range(9)])], ["id", "words"])
    sizes = [b.num_rows for b in fulltext._posted(iter([batch]))]
    assert sum(sizes) == 180 and max(sizes) == 10
