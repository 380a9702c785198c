"""Tables of the code model, and their enumerations.

Ids are 64-bit hashes of natural keys, so the same input gives the same ids;
offsets are UTF-8 bytes and lines are zero-based; a null target is unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language codes, and the file extensions that mean them.
LANGUAGES = ["c", "cpp", "csharp", "python", "typescript", "javascript", "go", "java", "shell", "bash", "unknown"]
EXTENSIONS = {
    "c": "c", "h": "c", "i": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "tpp": "cpp", "ipp": "cpp", "c++": "cpp", "h++": "cpp",
    "cs": "csharp", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "java": "java",
    "sh": "shell", "command": "shell", "bash": "bash",
}
#: Other names for a language.
ALIASES = {
    "c++": "cpp", "cxx": "cpp", "c#": "csharp", "cs": "csharp", "py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript",
    "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "sh": "shell",
    "posix-shell": "shell", "posix shell": "shell",
}
#: Interpreters named in a first line (python with any version), and their language.
INTERPRETERS = {"bash": "bash", "sh": "shell", "dash": "shell", "python": "python", "node": "javascript"}

#: Fixed values of the enumerated columns.
SYMBOL_KINDS = ["file", "namespace", "class", "struct", "interface", "function", "method", "variable", "module", "package", "macro", "enum", "type_alias", "field", "enum_member"]
OCCURRENCE_KINDS = ["definition", "declaration", "reference", "call", "import", "include", "inheritance", "implementation"]
RELATION_KINDS = ["contains", "calls", "inherits", "implements", "overrides", "imports", "includes"]
RESOLUTIONS = ["resolved", "ambiguous", "unresolved", "external"]
SEVERITIES = ["info", "warning", "error"]
DIAGNOSTIC_SOURCES = ["filesystem", "parser", "adapter", "resolver", "database", "indexer"]
JOB_TYPES = ["full", "incremental", "resolve", "rebuild_search"]
JOB_STATES = ["queued", "running", "cancelling", "cancelled", "completed", "failed"]
#: Job states that nothing follows.
JOB_ENDS = ["cancelled", "completed", "failed"]
WORKSPACE_STATES = ["idle", "indexing", "ready", "error"]
#: What highlight tokens may be, and their modifiers, bit by bit.
TOKEN_TYPES = [
    "type", "class", "enum", "interface", "struct", "typeParameter", "parameter", "variable", "property", "enumMember", "event", "function",
    "method", "macro", "keyword", "modifier", "comment", "string", "number", "regexp", "operator", "decorator", "label",
]
TOKEN_MODIFIERS = ["declaration", "definition", "readonly", "static", "deprecated", "abstract", "async", "modification", "documentation", "defaultLibrary"]


_RANGE = "start_byte bigint, end_byte bigint, start_line int, start_column int, end_line int, end_column int"
TABLES: dict[str, str] = {
    "workspace": "id bigint, name string, root string, status string, revision bigint, include array<string>, exclude array<string>, created_at timestamp",
    "workspace_settings": "workspace_id bigint, languages array<string>, include_paths array<string>, defines array<string>, fingerprint string",
    "workspace_source_root": "workspace_id bigint, position int, path string",
    "workspace_link": "source bigint, target bigint",
    "index_job": "id bigint, workspace_id bigint, job_type string, status string, stage string, total bigint, processed bigint, skipped bigint, errors bigint, warnings bigint, at timestamp",
    "file": "id bigint, workspace_id bigint, path string, language string, size bigint, mtime timestamp, content_hash string, is_binary boolean, is_deleted boolean",
    "file_content": "file_id bigint, workspace_id bigint, text string",
    "symbol": f"id bigint, workspace_id bigint, file_id bigint, symbol_key string, name string, qualified_name string, kind string, signature string, documentation string, scope string, scope_symbol_id bigint, is_definition boolean, {_RANGE}, body_start bigint, body_end bigint",
    "occurrence": f"id bigint, workspace_id bigint, file_id bigint, symbol_id bigint, kind string, name string, scope string, arity int, receiver string, metadata string, resolution string, confidence double, {_RANGE}",
    "reference": "id bigint, workspace_id bigint, file_id bigint, source_symbol_id bigint, target_symbol_id bigint, kind string, name string, resolution string, confidence double, set_id bigint, start_line int, start_column int",
    "relation": "workspace_id bigint, source_symbol_id bigint, target_symbol_id bigint, set_id bigint, kind string, target_name string, confidence double",
    "candidate_set": "set_id bigint, workspace_id bigint, candidate bigint",
    "dependency": "workspace_id bigint, source_file_id bigint, target_file_id bigint, raw_name string, kind string, resolution string, confidence double, reason string",
    "diagnostic": "id bigint, workspace_id bigint, file_id bigint, severity string, source string, code string, message string, start_line int, start_column int, at timestamp",
}


def columns(table: str) -> str:
    """A table's schema in DDL form."""
    return TABLES[table]


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def identifier(*parts: Column) -> Column:
    """A 64-bit id from a natural key."""
    return F.xxhash64(*parts)


def language_code(name: Column) -> Column:
    """Any name of a language to its code; unknown ones to ``unknown``."""
    lowered = F.lower(F.trim(name))
    known = F.create_map(*(x for k, v in ({c: c for c in LANGUAGES} | ALIASES).items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(known, lowered), F.lit("unknown"))


def valid(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose enumerated column holds one of its values."""
    return df.filter(F.col(column).isin(values))
