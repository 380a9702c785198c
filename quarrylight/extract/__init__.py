"""Facts from source text: a table function over files, one extractor per language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight import schema
from quarrylight.extract import python, scanner
from quarrylight.extract.facts import Facts
from quarrylight.functions.text import symbol_key

_SYMBOL = "name string, qualified_name string, kind string, scope string, signature string, documentation string, is_definition boolean, start_byte bigint, end_byte bigint, body_start bigint, body_end bigint, start_line int, start_column int, end_line int, end_column int"
_OCCURRENCE = "name string, kind string, scope string, arity int, receiver string, confidence double, metadata string, start_byte bigint, end_byte bigint, start_line int, start_column int, end_line int, end_column int"
_DIAGNOSTIC = "severity string, code string, message string, start_line int, start_column int"
FACTS = f"file_id bigint, workspace_id bigint, path string, language string, symbols array<struct<{_SYMBOL.replace(' ', ':').replace(',:', ',')}>>, occurrences array<struct<{_OCCURRENCE.replace(' ', ':').replace(',:', ',')}>>, diagnostics array<struct<{_DIAGNOSTIC.replace(' ', ':').replace(',:', ',')}>>"

#: The extractor of each language: (text, path) to facts.  Add to it to support another.
EXTRACTORS: dict[str, Callable[[str, str], Facts]] = {"python": python.extract} | {code: scanner.extractor(code) for code in scanner.LANGUAGES}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols, occurrences, diagnostics = [], [], []
        for path, language, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            facts = Facts(text or "")
            if (extract := EXTRACTORS.get(language)) and text:
                try:
                    facts = extract(text, path)
                except Exception as e:  # one odd file must not end the job; it is reported as such
                    facts.diagnostic("error", "extract.failed", f"{type(e).__name__}: {e}"[:200])
            symbols.append(facts.symbols)
            occurrences.append(facts.occurrences)
            diagnostics.append(facts.diagnostics)
        kinds = dict(zip(("symbols", "occurrences", "diagnostics"), map(_arrow, (_SYMBOL, _OCCURRENCE, _DIAGNOSTIC)), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(symbols, kinds["symbols"]), pa.array(occurrences, kinds["occurrences"]), pa.array(diagnostics, kinds["diagnostics"])], ["file_id", "workspace_id", "path", "language", "symbols", "occurrences", "diagnostics"])


def _arrow(fields: str) -> pa.DataType:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.list_(pa.struct([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")]))


def extract_facts(files: DataFrame) -> DataFrame:
    """(file_id, workspace_id, path, language, text) to one row of facts per file; no shuffle."""
    return files.select("file_id", "workspace_id", "path", "language", "text").mapInArrow(_run, FACTS)


def symbols(facts: DataFrame) -> DataFrame:
    """The symbol table; a symbol's parent is the file's first symbol whose qualified name is its scope."""
    rows = facts.select("file_id", "workspace_id", "path", "language", F.posexplode("symbols").alias("_n", "s")).select("file_id", "workspace_id", "path", "language", "_n", "s.*")
    key = symbol_key(F.col("language"), F.col("path"), F.col("kind"), F.col("qualified_name"), F.col("signature"))
    # equal keys within a file are told apart by their order, not their offset
    ordinal = F.row_number().over(Window.partitionBy("file_id", "_key").orderBy("start_byte"))
    keyed = rows.withColumn("_key", key).withColumn("_ord", ordinal).withColumn("symbol_key", F.when(F.col("_ord") == 1, F.col("_key")).otherwise(F.concat("_key", F.lit("~"), "_ord")))
    out = keyed.withColumn("id", schema.identifier(F.col("workspace_id"), F.col("symbol_key")))
    parents = out.groupBy("file_id", F.col("qualified_name").alias("scope")).agg(F.min_by("id", F.struct("start_byte", "id")).alias("scope_symbol_id"))
    joined = out.join(parents, ["file_id", "scope"], "left")
    return joined.select(*_names("symbol"))


def occurrences(facts: DataFrame) -> DataFrame:
    rows = facts.select("file_id", "workspace_id", F.posexplode("occurrences").alias("_n", "o")).select("file_id", "workspace_id", "_n", "o.*")
    out = rows.withColumns({"id": schema.identifier(F.col("file_id"), F.lit("occurrence"), F.col("_n")), "symbol_id": F.lit(None).cast("bigint"), "resolution": F.lit("unresolved")})
    return out.select(*_names("occurrence"))


def diagnostics(facts: DataFrame) -> DataFrame:
    rows = facts.select("file_id", "workspace_id", F.posexplode("diagnostics").alias("_n", "d")).select("file_id", "workspace_id", "_n", "d.*")
    out = rows.withColumns({"id": schema.identifier(F.col("file_id"), F.lit("diagnostic"), F.col("_n")), "source": F.lit("parser"), "at": F.current_timestamp()})
    return out.select(*_names("diagnostic"))


def _names(table: str) -> list[str]:
    return [f.split()[0] for f in schema.columns(table).split(", ")]
