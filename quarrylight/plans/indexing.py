"""Indexing a workspace: read, plan, extract, resolve, relate; all as plans over tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import extract, schema
from quarrylight.functions.text import arity, dotted_name, looks_like_interface, scope_hierarchy
from quarrylight.operators import dependencies, diff, graph, reach, relations, resolve, summary
from quarrylight.operators.graph import checkpoint
from quarrylight.plans import searching
from quarrylight.sources import discovery, projects
from quarrylight.sources.jobs import COUNTS, Run
from quarrylight.sources.store import Store

LIBRARY, IMPORTED, WORKSPACE = 1.0, 0.9, 0.8


def files_of(spark: SparkSession, root: str, workspace_id: int, **options) -> DataFrame:
    """The file table of a source tree, with text."""
    found = discovery.discover(spark, root, **options)
    return found.select(
        schema.identifier(F.lit(workspace_id).cast("bigint"), F.col("path")).alias("file_id"),
        F.lit(workspace_id).cast("bigint").alias("workspace_id"),
        "path",
        "language",
        "size",
        "mtime",
        "content_hash",
        "is_binary",
        "error",
        F.when(~F.col("is_binary"), discovery.text_of(F.col("content"))).alias("text"),
    )


def import_edges(made: DataFrame, files: DataFrame, library: DataFrame | None = None, search: DataFrame | None = None, module: str | None = None, maps: list | None = None) -> DataFrame:
    """The dependency table: one row per (file, name, kind).

    An import leads into the project where it can; else into a linked
    workspace's files (library: file_id, path, language, owner).
    """
    wanted = made.filter(F.col("kind").isin("import", "include")).select("workspace_id", F.col("file_id").alias("source_file_id"), F.coalesce(F.get_json_object("metadata", "$.path"), F.col("name")).alias("raw_name"), "kind").distinct()
    keyed = wanted.withColumn("_key", schema.identifier(F.col("source_file_id"), F.col("raw_name"), F.col("kind")))
    located = keyed.join(files.select(F.col("file_id").alias("source_file_id"), "path", "language"), "source_file_id").select("_key", "path", "language", "raw_name")
    known = lambda df: df.select("path", "language", F.col("file_id").alias("id"))
    found = dependencies.resolve(located, known(files), "_key", search, module, maps)
    if library is not None:
        lost = located.join(found.filter("target_file_id is null"), "_key", "left_semi")
        # equal paths of several linked workspaces: the smallest owner's
        first = library.groupBy("path").agg(F.min_by(F.struct("file_id", "language", "owner"), "owner").alias("f")).select("path", "f.*")
        there = dependencies.resolve(lost, known(first), "_key", search, module, maps).filter("target_file_id is not null")
        there = there.join(first.select(F.col("file_id").alias("target_file_id"), "owner"), "target_file_id").withColumn("reason", F.concat(F.lit("workspace:"), "owner")).drop("owner")
        found = found.join(there.select("_key"), "_key", "left_anti").unionByName(there)
    return keyed.join(found, "_key").select("workspace_id", "source_file_id", "target_file_id", "raw_name", "kind", "resolution", "confidence", "reason")


def resolve_occurrences(occurrences: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences with state, target, confidence, reason and the name of their set of candidates, and these sets (set_id, candidate).

    A qualified name is looked up as such, and nowhere else; a plain one in its
    enclosing scopes from the inside out, in its file, in imported files, then
    in the workspace among languages that see each other.  The first tier that
    has a candidate decides.  A call's number of arguments and a receiver narrow
    the candidates where both sides know them.

    The last tier pairs no use with a definition: its candidates are found once
    for each distinct name, language and number of arguments, and a set of two or
    more is stored once.
    """
    langs = files.select("file_id", "language")
    o = occurrences.join(langs, "file_id")
    s = symbols.join(langs, "file_id").select(F.col("id").alias("candidate"), F.col("file_id").alias("s_file"), F.col("workspace_id").alias("s_ws"), F.col("name").alias("s_name"), "qualified_name", F.col("scope").alias("s_scope"), F.col("kind").alias("s_kind"), F.col("language").alias("s_language"), arity(F.col("signature")).alias("s_arity"), looks_like_interface(F.col("name"), F.col("qualified_name"), F.col("signature")).alias("s_interface"))
    plain = o.filter(~F.col("name").rlike(r"::|\.")).select("id", "file_id", "workspace_id", "name", "scope", "language", "receiver", F.col("arity").alias("o_arity"))
    fits = F.col("s_arity").isNull() | F.col("o_arity").isNull() | (F.col("s_arity") == F.col("o_arity"))
    own = F.col("receiver").isNull() | F.col("receiver").isin("this", "self", "cls") | ~F.col("s_kind").isin("method", "function") | (F.col("s_scope") == F.col("receiver"))
    bare = F.regexp_replace("name", "^::", "")
    # a linked workspace's symbols count where the file imports theirs; the project's come first
    named = o.filter(F.col("name").rlike(r"::|\.")).withColumn("qualified_name", bare).join(s, "qualified_name").filter(resolve.compatible(F.col("language"), F.col("s_language")))
    explicit = named.filter(F.col("workspace_id") == F.col("s_ws")).select("id", "candidate")
    aliased = _aliased(o.filter(F.col("name").rlike(r"::|\.")), occurrences, s)
    linked = named.filter(F.col("workspace_id") != F.col("s_ws")).select("id", "candidate", "file_id", "s_file")
    scopes = plain.select("*", F.posexplode(scope_hierarchy(F.col("scope"))).alias("_depth", "_scope"))
    lexical = scopes.join(s, (scopes["file_id"] == s["s_file"]) & (scopes["name"] == s["s_name"]) & (scopes["_scope"] == s["s_scope"])).filter(fits & own)
    nearest = lexical.groupBy("id").agg(F.min("_depth").alias("_near"))
    lexical = lexical.join(nearest, "id").filter("_depth = _near").select("id", "candidate")
    in_file = plain.join(s, (F.col("file_id") == F.col("s_file")) & (F.col("name") == F.col("s_name"))).filter(fits & own).select("id", "candidate")
    # names meet by (file, name) before imports are asked about, and those are asked pair of files by pair of files
    steps = edges.filter("target_file_id is not null").select("source_file_id", "target_file_id")
    wanted = plain.select("file_id", "name").distinct().join(steps.select(F.col("source_file_id").alias("file_id")), "file_id", "left_semi")
    defined = s.select(F.col("s_name").alias("name"), "s_file").distinct().join(steps.select(F.col("target_file_id").alias("s_file")), "s_file", "left_semi")
    near = checkpoint(wanted.join(defined, "name").filter("file_id <> s_file"))
    asked = near.select("file_id", "s_file").unionByName(linked.select("file_id", "s_file")).distinct()
    found = reach.reach(steps, "source_file_id", "target_file_id").reaches(asked.withColumnsRenamed({"file_id": "root", "s_file": "node"}))
    within = checkpoint(found.filter("reached").select(F.col("root").alias("file_id"), F.col("node").alias("s_file")))
    linked = linked.join(within, ["file_id", "s_file"], "left_semi").select("id", "candidate")
    seen = near.join(within, ["file_id", "s_file"], "left_semi")
    imported = plain.join(seen, ["file_id", "name"]).join(s.withColumnRenamed("s_name", "name"), ["s_file", "name"]).filter(fits).select("id", "candidate")
    tiers = resolve.candidate_tiers(
        [("explicit", 1.0, explicit), ("explicit_alias", 1.0, aliased), ("explicit_linked", 1.0, linked), ("lexical", 1.0, lexical), ("same_file", 1.0, in_file), *_csharp(plain, occurrences, s), ("import", IMPORTED, imported)],
        "id",
        "candidate",
    )
    rank = F.when(F.col("s_interface"), 0).otherwise(1).alias("rank")
    first = checkpoint(resolve.first_tier(tiers, "id").join(s.select("candidate", rank), "candidate"))
    by_use, use_sets = resolve.candidate_sets(first, ["id"], "candidate", "rank", 2)
    reasons = first.groupBy("id").agg(F.first("reason").alias("reason"), F.first("confidence").alias("confidence"))
    # the workspace tier, by what a use asks for
    ask = ["workspace_id", "name", "language", "o_arity"]
    rest = plain.join(reasons.select("id"), "id", "left_anti").withColumn("o_arity", F.coalesce("o_arity", F.lit(-1))).select("id", *ask)
    known = F.col("s_arity").isNull() | (F.col("o_arity") < 0) | (F.col("s_arity") == F.col("o_arity"))
    there = s.select(F.col("s_ws").alias("workspace_id"), F.col("s_name").alias("name"), "candidate", "s_language", "s_arity", rank)
    anywhere = rest.select(*ask).distinct().join(there, ["workspace_id", "name"]).filter(known & resolve.compatible(F.col("language"), F.col("s_language")))
    by_ask, ask_sets = resolve.candidate_sets(checkpoint(anywhere.select(*ask, "candidate", "rank")), ask, "candidate", "rank", 2)
    far = rest.join(by_ask, ask).select("id", "set_id", "n", "first", F.lit("workspace").alias("reason"), F.lit(WORKSPACE).alias("_sure"))
    hits = by_use.join(reasons.withColumnRenamed("confidence", "_sure"), "id").select(*far.columns).unionByName(far)
    n = F.coalesce("n", F.lit(0))
    kept = [c for c in occurrences.columns if c not in ("resolution", "confidence")]
    resolved = occurrences.select(*kept).join(hits, "id", "left").select(
        *kept,
        F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("resolution"),
        F.col("first").alias("target"),
        F.when(n == 0, 0.0).when(n == 1, F.col("_sure")).otherwise(0.5).alias("confidence"),
        F.coalesce("reason", F.lit("none")).alias("reason"),
        "set_id",
    )
    return resolved, use_sets.unionByName(ask_sets).distinct()


def _uses(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C#'s usings of files, and those that hold for every file of a workspace: (file_id or workspace_id, _opened, _alias, _static)."""
    said = lambda name: F.get_json_object("metadata", f"$.{name}")
    uses = occurrences.filter("kind = 'import'").select("file_id", "workspace_id", dotted_name(F.col("name")).alias("_opened"), said("alias").alias("_alias"), F.coalesce(said("static") == "true", F.lit(False)).alias("_static"), F.coalesce(said("global") == "true", F.lit(False)).alias("_global"))
    of = lambda key, which: uses.filter(which).select(key, "_opened", "_alias", "_static").distinct()
    return of("file_id", ~F.col("_global")), of("workspace_id", F.col("_global"))


def _using(names: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Names with each using that holds where they stand."""
    own, everywhere = _uses(occurrences)
    return names.join(own, "file_id").unionByName(names.join(everywhere, "workspace_id"))


def _aliased(named: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidates of C# names that begin with an alias, as ``A.Thing.Run`` or ``A::Thing`` after ``using A = N;``."""
    dotted = named.filter("language = 'csharp'").select("id", "file_id", "workspace_id", dotted_name(F.col("name")).alias("_written"))
    dotted = dotted.filter(F.col("_written").contains(".")).withColumn("_first", F.substring_index("_written", ".", 1))
    meant = _using(dotted, occurrences).filter("_alias = _first").select("id", "workspace_id", F.concat(F.col("_opened"), F.substring(F.col("_written"), F.length("_first") + 1, F.length("_written"))).alias("qualified_name"))
    there = symbols.filter("s_language = 'csharp'").select("candidate", F.col("s_ws").alias("workspace_id"), "qualified_name")
    return meant.join(there, ["workspace_id", "qualified_name"]).select("id", "candidate")


def _csharp(plain: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> list[tuple[str, float, DataFrame]]:
    """C#'s own tiers for plain names: the enclosing namespaces in any file, an alias, what ``using`` opens, then the members that ``using static`` does."""
    own = plain.filter("language = 'csharp'")
    there = symbols.filter("s_language = 'csharp'").select("candidate", "s_ws", F.col("qualified_name").alias("_q"))
    at = lambda df: df.join(there, "_q").filter(F.col("workspace_id") == F.col("s_ws")).select("id", "candidate")
    joined = lambda scope: F.when(F.col(scope) == "", F.col("name")).otherwise(F.concat_ws(".", scope, "name"))
    around = own.select("*", F.posexplode(scope_hierarchy(F.col("scope"))).alias("_depth", "_scope")).filter("_scope <> ''").withColumn("_q", joined("_scope"))
    around = around.join(there, "_q").filter(F.col("workspace_id") == F.col("s_ws"))
    near = around.join(around.groupBy("id").agg(F.min("_depth").alias("_near")), "id").filter("_depth = _near")
    opened = _using(own, occurrences)
    alias = at(opened.filter("_alias = name").withColumn("_q", F.col("_opened")))
    using = at(opened.filter("_alias is null and not _static").withColumn("_q", joined("_opened")))
    members = at(opened.filter("_alias is null and _static").withColumn("_q", joined("_opened")))
    return [("namespace", 1.0, near.select("id", "candidate")), ("alias", 1.0, alias), ("using", 0.9, using), ("using_static", 0.9, members)]


def references_of(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """The reference table: who refers to what; the source is the symbol whose qualified name is the scope."""
    owner = symbols.groupBy("file_id", F.col("qualified_name").alias("scope")).agg(F.min("id").alias("source_symbol_id"))
    rows = resolved.filter(F.col("kind").isin("call", "reference", "inheritance", "implementation")).join(owner, ["file_id", "scope"], "left")
    return rows.select("id", "workspace_id", "file_id", "source_symbol_id", F.col("target").alias("target_symbol_id"), "kind", "name", "resolution", "confidence", "set_id", "start_line", "start_column")


def index(spark: SparkSession, store: Store, root: str, workspace_id: int, force: bool = False, search: DataFrame | None = None, module: str | None = None, maps: list | None = None, job: int | None = None, **options) -> dict[str, int]:
    """Indexes a tree into the store; only new and changed files are parsed.

    Returns the counts of the run.  Unreadable files keep what the store has of
    them and are reported as diagnostics.  Workspaces that link to this one are
    resolved anew, those that link to them are not.  ``search`` holds search
    paths of a compile database, ``module`` a Go module's name, ``maps`` path maps
    of a TypeScript project; what isn't given is taken from the project files at
    the root.  One commit holds the run: its facts, what they resolve to, and its
    row of the job table.  The job log has the states and stages before; a run that is asked to stop
    (:meth:`quarrylight.sources.jobs.JobLog.cancel`, by the ``job`` id) raises
    ``Cancelled`` and leaves the store's version as it was.
    """
    kind = "full" if force else "incremental"
    with Run(store.log, job if job is not None else uuid.uuid4().int >> 65, workspace_id, kind) as run:
        counts = _indexed(spark, store, root, workspace_id, force, search, module, maps, run, **options)
    searching.refresh(store, workspace_id)
    for row in store.table("workspace_link").filter(F.col("target") == workspace_id).select("source").distinct().collect():
        resolve_workspace(store, row["source"])
    return counts


def _indexed(spark: SparkSession, store: Store, root: str, workspace_id: int, force: bool, search: DataFrame | None, module: str | None, maps: list | None, run: Run, **options) -> dict[str, int]:
    run.stage("discovering")
    project = projects.settings(spark, root)
    search, module, maps = (given if given is not None else project[name] for name, given in (("search", search), ("module", module), ("maps", maps)))
    found = graph.checkpoint(files_of(spark, root, workspace_id, **options))
    mine = lambda name: store.table(name, workspaces=[workspace_id]).filter(F.col("workspace_id") == workspace_id)
    stored = mine("file")
    run.stage("planning")
    planned = graph.checkpoint(diff.plan(found, stored, "path", "content_hash", "language", ["size"], "is_deleted", force))
    counts = {r["action"]: r["n"] for r in planned.groupBy("action").agg(F.count("*").alias("n")).collect()}
    processed, skipped = counts.get("process", 0), counts.get("skip", 0) + counts.get("touch", 0)
    run.counts = {"total": sum(counts.values()), "processed": processed, "skipped": skipped}
    run.stage("extracting")
    unreadable = F.col("is_binary") | F.col("error").isNotNull()
    work = found.join(planned.filter("action = 'process'").select("path"), "path", "left_semi").filter(~unreadable)
    facts = graph.checkpoint(extract.extract_facts(work))
    gone = planned.filter("action = 'remove'").select(schema.identifier(F.lit(workspace_id).cast("bigint"), F.col("path")).alias("file_id"))
    replaced = graph.checkpoint(work.select("file_id").unionByName(gone))
    keep = lambda name: mine(name).join(replaced, "file_id", "left_anti")
    columns = lambda df, name: df.select(*extract._names(name))
    file_rows = found.select(F.col("file_id").alias("id"), "workspace_id", "path", "language", "size", "mtime", "content_hash", "is_binary", F.lit(False).alias("is_deleted"))
    dead = stored.join(found.select("path"), "path", "left_anti").withColumn("is_deleted", F.lit(True))
    unread = discovery.failed(found).join(found.select("path", "file_id", "workspace_id"), "path")
    unread = unread.withColumns({"id": schema.identifier(F.col("file_id"), F.lit("filesystem")), "start_line": F.lit(0), "start_column": F.lit(0), "at": F.current_timestamp()})
    kept_text = mine("file_content").join(found.filter(unreadable).select("file_id"), "file_id", "left_semi")
    fresh = {
        "file": columns(file_rows, "file").unionByName(columns(dead, "file")),
        "symbol": graph.checkpoint(keep("symbol").unionByName(extract.symbols(facts))),
        "occurrence": graph.checkpoint(keep("occurrence").unionByName(extract.occurrences(facts))),
    }
    noted = graph.checkpoint(columns(keep("diagnostic").filter("source <> 'filesystem'"), "diagnostic").unionByName(extract.diagnostics(facts)).unionByName(columns(unread, "diagnostic")))
    said = noted.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).first()
    run.counts |= said.asDict()
    run.stage("resolving")
    contents = found.filter("text is not null").select("file_id", "workspace_id", "text").unionByName(kept_text.select("file_id", "workspace_id", "text"))
    tables, _ = _resolved_tables(store, workspace_id, search, module, maps, fresh)
    run.stage("writing")
    long = lambda n: F.lit(n).cast("bigint")
    row = spark.range(1).select(
        long(run.job).alias("id"), long(workspace_id).alias("workspace_id"), F.lit(run.job_type).alias("job_type"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("stage"), *(long(run.counts[c]).alias(c) for c in COUNTS), F.current_timestamp().alias("at")
    )
    store.commit(fresh | {"file_content": contents, "diagnostic": noted} | tables, workspace_id, added={"index_job": row})
    return {"processed": processed, "skipped": skipped, "removed": counts.get("remove", 0)}


def resolve_workspace(store: Store, workspace_id: int, search: DataFrame | None = None, module: str | None = None, maps: list | None = None) -> dict[str, int]:
    """Imports, occurrences, references and relations of one workspace, anew from its facts and those it links to.

    Project settings that aren't given are taken from the files at the root the
    workspace is registered with, if any.
    """
    at = store.table("workspace").filter(F.col("id") == workspace_id).select("root").first()
    project = projects.settings(store.spark, at["root"]) if at else {}
    search, module, maps = (given if given is not None else project.get(name) for name, given in (("search", search), ("module", module), ("maps", maps)))
    tables, resolved = _resolved_tables(store, workspace_id, search, module, maps, {})
    store.commit(tables, workspace_id)
    return summary.resolution_counts(resolved, "resolution", resolve.STATES).first().asDict()


def _resolved_tables(store: Store, workspace_id: int, search: DataFrame | None, module: str | None, maps: list | None, fresh: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The resolved tables of a workspace and its occurrences; ``fresh`` holds its tables that aren't committed yet."""
    linked = [r["target"] for r in store.table("workspace_link").filter(F.col("source") == workspace_id).select("target").distinct().collect()]
    own = F.col("workspace_id") == workspace_id

    def seen(name: str) -> DataFrame:
        stored = store.table(name, workspaces=[workspace_id, *linked]).filter(F.col("workspace_id").isin([workspace_id, *linked]))
        return stored.filter(~own).unionByName(fresh[name]) if name in fresh else stored

    files = seen("file").filter(~F.col("is_deleted")).select(F.col("id").alias("file_id"), "workspace_id", "path", "language")
    symbols, occurrences = graph.checkpoint(seen("symbol")), graph.checkpoint(seen("occurrence"))
    library = files.filter(~own).withColumnRenamed("workspace_id", "owner") if linked else None
    edges = graph.checkpoint(import_edges(occurrences.filter(own), files.filter(own), library, search, module, maps))
    # a linked workspace's own imports carry on from where this one's lead into it
    onward = edges.unionByName(store.table("dependency", workspaces=linked).filter(F.col("workspace_id").isin(linked))) if linked else edges
    resolved, sets = (graph.checkpoint(df) for df in resolve_occurrences(occurrences.filter(own), symbols, onward, files))
    refs = references_of(resolved, symbols.filter(own))
    occ = resolved.withColumn("symbol_id", F.when(F.col("resolution") == "resolved", F.col("target")))
    related, named = relations.build(symbols.filter(own), occ, refs, edges, files.filter(own))
    every = sets.unionByName(named).distinct().withColumn("workspace_id", F.lit(workspace_id).cast("bigint"))
    columns = lambda df, name: df.select(*extract._names(name))
    return {"occurrence": columns(occ, "occurrence"), "reference": columns(refs, "reference"), "relation": columns(related, "relation"), "dependency": columns(edges, "dependency"), "candidate_set": columns(every, "candidate_set")}, resolved
