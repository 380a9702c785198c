"""One function per entry point of the code browser; each returns a DataFrame over the store's tables.

Lists are paged (default 50, at most 200).  Everything is restricted to what
the workspace sees: itself and the workspaces it links to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight import schema
from quarrylight.extract import highlight
from quarrylight.functions import ranges
from quarrylight.functions.text import modifier_mask
from quarrylight.operators import diff, graph, intervals, paging, paths, refs, relations, scope, search, summary
from quarrylight.plans import searching
from quarrylight.sources import projects
from quarrylight.sources.discovery import capture
from quarrylight.sources.store import Store

class Api:
    """Reads one version of the store."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def _own(self, table: str, ws: int) -> DataFrame:
        return self.store.table(table, workspaces=[ws]).filter(F.col("workspace_id") == ws)

    def _visible(self, ws: int) -> list[int]:
        owners = self.spark.range(1).select(F.lit(ws).cast("long").alias("id"))
        pairs = scope.visibility(owners, "id", self.store.table("workspace_link").filter(F.col("source") == ws))
        return sorted(r["owner"] for r in pairs.select("owner").distinct().collect())  # the links of one workspace

    def _seen(self, table: str, ws: int) -> DataFrame:
        """Rows of the workspace and of those it links to, whose parts alone are read."""
        seen = self._visible(ws)
        return self.store.table(table, workspaces=seen).filter(F.col("workspace_id").isin(seen))

    # workspaces and jobs
    def health(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("ok").alias("status"), F.lit(self.store.version()).alias("version"))

    def workspaces(self) -> DataFrame:
        return self.store.table("workspace").orderBy("id")

    def create_workspace(self, name: str, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> int:
        row = self.spark.range(1).select(schema.identifier(F.lit(name), F.lit(root)).alias("id"), F.lit(name).alias("name"), F.lit(root).alias("root"), F.lit("idle").alias("status"), F.lit(0).cast("long").alias("revision"), F.lit(include or []).cast("array<string>").alias("include"), F.lit(exclude or []).cast("array<string>").alias("exclude"), F.current_timestamp().alias("created_at"))
        id_ = row.first()["id"]
        self.store.insert_missing("workspace", row, ["id"])
        return id_

    def workspace(self, ws: int) -> DataFrame:
        return self.store.table("workspace").filter(F.col("id") == ws)

    def change_workspace(self, ws: int, name: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> None:
        """Changes what is given.  New globs take effect with the next run; the stored hashes are forgotten, so it parses every file anew."""
        new = {"name": name, "include": include, "exclude": exclude}
        value = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
        own, at = F.col("id") == ws, self.store.version()
        changed = self.store.table("workspace", at).withColumns({k: F.when(own, value(v)).otherwise(F.col(k)) for k, v in new.items() if v is not None})
        changed = changed.withColumn("revision", F.when(own, F.col("revision") + 1).otherwise(F.col("revision")))
        files = self.store.table("file", at, [ws]).filter(F.col("workspace_id") == ws)
        forgotten = {"file": diff.forget_hashes(files, "content_hash", F.lit(True))} if include is not None or exclude is not None else {}
        self.store.commit(forgotten, ws, base=at, whole={"workspace": changed})

    def status(self, ws: int) -> DataFrame:
        """The workspace's state by its newest job: idle without one, indexing while it runs, error when it failed, else ready."""
        newest = self.store.latest_jobs(ws, 1).select(F.col("workspace_id").alias("id"), F.col("status").alias("_job"), F.col("at").alias("since"))
        state = F.when(F.col("_job").isNull(), "idle").when(F.col("_job").isin("queued", "running", "cancelling"), "indexing").when(F.col("_job") == "failed", "error").otherwise("ready")
        return self.workspace(ws).select("id", "name", "revision").join(newest, "id", "left").select("id", "name", "revision", state.alias("status"), "since")

    def delete_workspace(self, ws: int) -> None:
        self.store.delete_workspace(ws)

    def link(self, source: int, target: int) -> None:
        if source == target:
            raise ValueError("a workspace can't link to itself")
        row = self.spark.range(1).select(F.lit(source).cast("long").alias("source"), F.lit(target).cast("long").alias("target"))
        self.store.insert_missing("workspace_link", row, ["source", "target"])

    def unlink(self, source: int, target: int) -> None:
        at = self.store.version()
        links = self.store.table("workspace_link", at)
        self.store.commit({"workspace_link": links.filter((F.col("source") != source) | (F.col("target") != target))}, base=at)

    def links(self, ws: int) -> DataFrame:
        return self.store.table("workspace_link").filter(F.col("source") == ws).select("target").orderBy("target")

    def consumers(self, ws: int) -> DataFrame:
        """Workspaces that link to this one, directly; they are resolved anew after it is indexed."""
        return self.store.table("workspace_link").filter(F.col("target") == ws).select("source").orderBy("source")

    def log_job(self, ws: int, job: int, job_type: str, status: str, **counts: int) -> None:
        c = {k: counts.get(k, 0) for k in ("total", "processed", "skipped", "errors", "warnings")}
        row = self.spark.range(1).select(F.lit(job).cast("long").alias("id"), F.lit(ws).cast("long").alias("workspace_id"), F.lit(job_type).alias("job_type"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("stage"), *(F.lit(v).cast("long").alias(k) for k, v in c.items()), F.current_timestamp().alias("at"))
        self.store.append("index_job", row)

    def jobs(self, ws: int, limit: int = 20) -> DataFrame:
        return self.store.latest_jobs(ws, limit)

    def job(self, ws: int, job: int) -> DataFrame:
        """One job's state."""
        return self.store.latest_jobs(ws, 1, job)

    def job_history(self, ws: int, job: int) -> DataFrame:
        """Every state and stage that a job has been in, oldest first."""
        every = self.store.table("index_job").unionByName(self.store.log.rows())
        return every.filter((F.col("workspace_id") == ws) & (F.col("id") == job)).orderBy("at")

    def cancel(self, ws: int, job: int) -> bool:
        """Asks a running job to stop; it commits nothing then.  False where it has ended."""
        return self.store.cancel(job, ws)

    def compile_command(self, ws: int, path: str) -> DataFrame:
        """What the compile database at the workspace's root says of a file: search paths, macros and settings."""
        root = self.workspace(ws).select("root").first()["root"]
        if not capture(root, "compile_commands.json")[0]:
            return self.spark.createDataFrame([], projects.CONTEXT)
        contexts = projects.compile_commands(self.spark, f"{root.rstrip('/')}/compile_commands.json")
        return projects.rebased(contexts, root).filter(F.col("file") == path)

    def summary(self, ws: int) -> DataFrame:
        """One row: active files, symbols, diagnostics by severity, and files per language."""
        files = self._own("file", ws).filter(~F.col("is_deleted"))
        languages = summary.count_by(files, "language").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "language", "n"))).alias("l")).select(F.transform("l", lambda x: F.struct(x["language"].alias("language"), x["n"].alias("n"))).alias("languages"))
        severity = F.col("severity")
        found = summary.conditional_counts(self._own("diagnostic", ws), {"errors": severity == "error", "warnings": severity == "warning"}, "diagnostics", "others")
        one = lambda df: df.withColumn("_k", F.lit(1))
        out = one(files.agg(F.count("*").alias("files")))
        for part in (self._own("symbol", ws).agg(F.count("*").alias("symbols")), found, languages):
            out = out.join(one(part), "_k")  # single rows
        return out.drop("_k")

    # files
    def tree(self, ws: int, path: str = "", hidden: list[str] | None = None) -> DataFrame:
        below = paths.children(self._own("file", ws).filter(~F.col("is_deleted")), "path", path)
        return below.filter(~paths.ignored(F.col("name"), hidden)) if hidden else below

    def file(self, ws: int, file_id: int) -> DataFrame:
        return self._seen("file", ws).filter(F.col("id") == file_id)

    def content(self, ws: int, file_id: int, start_line: int | None = None, end_line: int | None = None, start_byte: int | None = None, end_byte: int | None = None) -> DataFrame:
        lit = lambda x: F.lit(x).cast("int")
        sliced = ranges.content_slice(F.col("text"), lit(start_line), lit(end_line), lit(start_byte), lit(end_byte))
        return self._seen("file_content", ws).filter(F.col("file_id") == file_id).select("file_id", sliced.alias("text"))

    def file_symbols(self, ws: int, file_id: int) -> DataFrame:
        return self._seen("symbol", ws).filter(F.col("file_id") == file_id).orderBy("start_byte", F.desc("end_byte"), "name")

    def outline(self, ws: int, file_id: int, name: str | None = None) -> DataFrame:
        symbols = self._seen("symbol", ws).filter(F.col("file_id") == file_id)
        rows = graph.outline(symbols, "id", "scope_symbol_id", ["start_byte", "end_byte", "name"]).join(symbols, "id").select("id", "name", "kind", "level", "path", "place", "start_line", "end_line", "start_byte")
        rows = rows.filter(F.contains(F.lower("name"), F.lit(name.lower()))) if name else rows
        return rows.orderBy("start_byte", "level")

    def symbol_at(self, ws: int, file_id: int, offset: int) -> DataFrame:
        """The smallest symbol whose body holds a byte offset."""
        own = self._seen("symbol", ws).filter(F.col("file_id") == file_id)
        return intervals.find_at(own, F.lit(offset), "body_start", "body_end").limit(1)

    def occurrences(self, ws: int, file_id: int, kind: str | None = None, start_byte: int | None = None, end_byte: int | None = None) -> DataFrame:
        """A file's occurrences; targets that the workspace doesn't see are hidden."""
        rows = self._seen("occurrence", ws).filter(F.col("file_id") == file_id)
        rows = rows.filter(F.col("kind") == kind) if kind else rows
        rows = intervals.inside(rows, start_byte, end_byte, "start_byte", "end_byte") if start_byte is not None and end_byte is not None else rows
        seen = self._seen("symbol", ws).select(F.col("id").alias("symbol_id"), F.lit(True).alias("_seen"))
        shown = rows.join(seen, "symbol_id", "left")
        hidden = F.col("symbol_id").isNotNull() & F.col("_seen").isNull()
        return shown.withColumns({"symbol_id": F.when(~hidden, F.col("symbol_id")), "resolution": F.when(hidden, "unresolved").otherwise(F.col("resolution"))}).drop("_seen").orderBy("start_byte", "end_byte")

    def highlights(self, ws: int, file_id: int) -> DataFrame:
        """Tokens by line and column, from a file's symbols, its occurrences and its text; type and modifiers as places in the legend.

        Of tokens that begin at one place the symbol is shown, else the occurrence,
        else what the text alone says.
        """
        names = self.file_symbols(ws, file_id).filter("kind <> 'module'").select("start_line", "start_column", (F.col("end_byte") - F.col("start_byte")).alias("length"), F.when(F.col("kind") == "field", "property").when(F.col("kind") == "enum_member", "enumMember").when(F.col("kind") == "type_alias", "type").otherwise(F.col("kind")).alias("type"), F.when(F.col("is_definition"), F.array(F.lit("declaration"), F.lit("definition"))).otherwise(F.array(F.lit("declaration"))).alias("modifiers"))
        uses = self.occurrences(ws, file_id).filter("kind in ('call', 'reference')").select("start_line", "start_column", (F.col("end_byte") - F.col("start_byte")).alias("length"), F.when(F.col("kind") == "call", "function").otherwise("variable").alias("type"), F.array().cast("array<string>").alias("modifiers"))
        language = self.file(ws, file_id).select(F.col("id").alias("file_id"), "language")
        text = self._seen("file_content", ws).filter(F.col("file_id") == file_id).join(language, "file_id")
        lexical = highlight.lexical(text).withColumn("modifiers", F.array().cast("array<string>"))
        ranked = [df.withColumn("_rank", F.lit(i)) for i, df in enumerate((names, uses, lexical))]
        every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
        first = every.groupBy("start_line", "start_column").agg(F.min(F.struct("_rank", F.col("length").alias("length"), "type", "modifiers")).alias("t"))
        shown = first.select("start_line", "start_column", "t.length", "t.type", "t.modifiers")
        places = F.create_map(*(x for i, t in enumerate(schema.TOKEN_TYPES) for x in (F.lit(t), F.lit(i))))
        coded = shown.withColumns({"token_type": F.coalesce(F.try_element_at(places, F.col("type")), F.lit(schema.TOKEN_TYPES.index("type"))), "token_modifiers": modifier_mask(F.col("modifiers"), schema.TOKEN_MODIFIERS)})
        return coded.orderBy("start_line", "start_column")

    def diagnostics(self, ws: int, severity: str | None = None, file_id: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        rows = self._own("diagnostic", ws)
        rows = rows.filter(F.col("severity") == severity) if severity else rows
        if file_id is not None:
            return rows.filter(F.col("file_id") == file_id).orderBy("start_line", "start_column")
        return rows.orderBy(F.desc("at"), "id").offset(offset).limit(limit)

    # symbols
    def symbols(self, ws: int, query: str | None = None, kind: str | None = None, language: str | None = None, file_id: int | None = None, limit: int = 50, offset: int = 0, hits: int | None = None) -> DataFrame:
        rows = self._seen("symbol", ws)
        if language:
            rows = rows.join(self._seen("file", ws).filter(F.col("language") == language).select(F.col("id").alias("file_id")), "file_id", "left_semi")
        for column, value in (("kind", kind), ("file_id", file_id)):
            rows = rows.filter(F.col(column) == value) if value is not None else rows
        if query:  # after the filters, so that none of their hits is lost; hits limits the search itself
            found = search.search(rows, query, "id", ["name", "qualified_name", "signature", "documentation"], folded=True)
            found = found.orderBy("rank", "id").limit(hits) if hits else found
            rows = rows.join(found.select("id"), "id", "left_semi")
        return paging.page(rows, [F.col("name"), F.col("id")], limit, offset)

    def symbol(self, ws: int, symbol_id: int) -> DataFrame:
        """A symbol with the numbers of its referencers, callers and callees."""
        one = self._seen("symbol", ws).filter(F.col("id") == symbol_id)
        count = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
        out = one.withColumn("_k", F.lit(1))
        for name, df in (("referencers", self._referencers(ws, symbol_id)), ("callers", self.callers(ws, symbol_id)), ("callees", self.callees(ws, symbol_id))):
            out = out.join(count(df, name), "_k")  # single rows
        return out.drop("_k")

    def definitions(self, ws: int, symbol_id: int) -> DataFrame:
        """All symbols of the symbol's qualified name, definitions first."""
        seen = self._seen("symbol", ws)
        name = seen.filter(F.col("id") == symbol_id).select("qualified_name")
        return seen.join(name, "qualified_name", "left_semi").orderBy(F.desc("is_definition"), "file_id", "start_byte")

    def _referencers(self, ws: int, symbol_id: int) -> DataFrame:
        one = self._seen("symbol", ws).filter(F.col("id") == symbol_id)
        return refs.referencers_of_sets(self._own("reference", ws), self._own("candidate_set", ws), one, "id", "target_symbol_id", "name", "id", "name", ["file_id", "source_symbol_id", "kind", "resolution", "start_line", "start_column"])

    def references(self, ws: int, symbol_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
        files = self._own("file", ws).select(F.col("id").alias("file_id"), "path")
        return paging.page(self._referencers(ws, symbol_id).join(files, "file_id"), [F.col("path"), F.col("start_line"), F.col("start_column"), F.col("id")], limit, offset)

    def callers(self, ws: int, symbol_id: int) -> DataFrame:
        calls = self._referencers(ws, symbol_id).filter("kind = 'call' and source_symbol_id is not null")
        return self._seen("symbol", ws).join(calls.select(F.col("source_symbol_id").alias("id")).distinct(), "id", "left_semi").orderBy("name", "id")

    def callees(self, ws: int, symbol_id: int) -> DataFrame:
        calls = self._own("reference", ws).filter((F.col("kind") == "call") & (F.col("source_symbol_id") == symbol_id))
        return self._seen("symbol", ws).join(calls.select(F.col("target_symbol_id").alias("id")).distinct(), "id", "left_semi").orderBy("name", "id")

    def graph(self, ws: int, symbol_id: int, depth: int = 1, max_nodes: int = 50, max_edges: int = 100, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
        """Nodes, distinct edges, and whether a cap cut them."""
        if depth < 0 or max_nodes < 0 or max_edges < 0:
            raise ValueError("bounds must not be negative")
        seen = self._seen("symbol", ws).select("id", "name", "kind")
        edges = relations.expanded(self._seen("relation", ws), self._seen("candidate_set", ws))
        nodes, out, cut = graph.expand(edges, symbol_id, "source_symbol_id", "target_symbol_id", "kind", kinds, ["calls"], depth, min(max(max_nodes, 1), 500), min(max(max_edges, 1), 1000))
        return nodes.join(seen, "id", "left"), out, cut

    # search
    def search_source(self, ws: int, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
        """Files of the workspace alone, best first, with a snippet."""
        parsed = search.parse_query(query, ["text"])
        texts = self._own("file_content", ws)
        hits = searching.hits(self.store, "file_content", [ws], parsed, texts)
        best = paging.page(hits, [F.col("rank"), F.col("id")], limit, offset)
        files = self._own("file", ws).select("id", "path")
        shown = best.join(texts.select(F.col("file_id").alias("id"), "text"), "id").join(files, "id")
        return shown.select("id", "path", "rank", search.snippet(F.col("text"), parsed.scored() or [""]).alias("snippet"), "total", "has_more").orderBy("rank", "id")

    def search_symbols(self, ws: int, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
        """Full-text hits, else exact names, and calls of that name that lead nowhere."""
        symbols = self._seen("symbol", ws)
        parsed = search.parse_query(query, searching.INDEXED["symbol"][1])
        hits = search.with_fallback(searching.hits(self.store, "symbol", self._visible(ws), parsed, symbols), symbols, query, "id", "name")
        unresolved = self._own("reference", ws).filter("target_symbol_id is null and kind = 'call'").withColumn("_id", F.coalesce("source_symbol_id", "id"))
        loose = search.loose_hits(unresolved, query, "_id", "name").distinct() if query else hits.limit(0)
        return paging.page(hits.unionByName(loose), [F.col("rank"), F.col("id")], limit, offset).join(symbols.select("id", "name", "qualified_name", "kind", "file_id"), "id", "left").orderBy("rank", "id")

    def unresolved_calls(self, ws: int, query: str, limit: int = 50) -> DataFrame:
        """Calls without a target whose name is like the query: the very name, beginnings, then the rest."""
        calls = self._own("reference", ws).filter("target_symbol_id is null and kind = 'call'")
        files = self._own("file", ws).select(F.col("id").alias("file_id"), "path")
        return search.bucketed(calls, query, "name").join(files, "file_id").orderBy("bucket", "name", "path", "start_line", "id").limit(limit)
