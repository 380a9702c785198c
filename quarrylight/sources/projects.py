"""Project files: compile databases, TypeScript settings, Go modules."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.dependencies import joined
from quarrylight.sources.discovery import capture

#: Flags with a path, by what they add to.
PATH_FLAGS = {"-iquote": "quote", "-I": "include", "-isystem": "system", "-idirafter": "after"}
SEARCH_ORDER = ["quote", "include", "system", "after"]
CONTEXT = "directory string, file string, output string, standard string, sysroot string, no_standard boolean, quote array<string>, include array<string>, system array<string>, after array<string>, macros array<struct<name:string,value:string,defined:boolean>>"


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of a compile database: its file, search paths in order, and macros."""
    raw = spark.read.schema("directory string, file string, output string, command string, arguments array<string>").json(path, multiLine=True)
    return raw.filter("file is not null").mapInArrow(_contexts, CONTEXT)


def split_command(command: str) -> list[str]:
    """A shell command's words; one with an open quote is split at blanks."""
    try:
        return shlex.split(command)
    except ValueError:
        return command.split()


def parse_arguments(arguments: list[str]) -> dict:
    """Search paths, macros and settings of one compiler call."""
    out: dict = {"output": None, "standard": None, "sysroot": None, "no_standard": False, "macros": [], **{k: [] for k in SEARCH_ORDER}}
    it = iter(arguments[1:])

    def value(arg: str, flag: str) -> str | None:
        return arg[len(flag) :] if len(arg) > len(flag) else next(it, None)

    for arg in it:
        flag = next((f for f in sorted(PATH_FLAGS, key=len, reverse=True) if arg.startswith(f)), None)
        if flag:
            if v := value(arg, flag):
                out[PATH_FLAGS[flag]].append(v)
        elif arg.startswith(("-D", "-U")):
            if v := value(arg, arg[:2]):
                name, _, body = v.partition("=")
                out["macros"].append({"name": name, "value": (body if "=" in v else "1") if arg[1] == "D" else None, "defined": arg[1] == "D"})
        elif arg.startswith("-std="):
            out["standard"] = arg[5:]
        elif arg.startswith("--sysroot") or arg == "-isysroot":
            out["sysroot"] = arg.partition("=")[2] or next(it, None)
        elif arg in ("-nostdinc", "-nostdinc++"):
            out["no_standard"] = True
        elif arg == "-o":
            out["output"] = next(it, None)
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    schema = pa.schema([("directory", pa.string()), ("file", pa.string()), ("output", pa.string()), ("standard", pa.string()), ("sysroot", pa.string()), ("no_standard", pa.bool_()), *((k, strings) for k in SEARCH_ORDER), ("macros", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("defined", pa.bool_())])))])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parsed = parse_arguments(r["arguments"] or split_command(r["command"] or ""))
            rows.append(parsed | {"directory": r["directory"], "file": r["file"], "output": r["output"] or parsed["output"]})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def rebased(contexts: DataFrame, root: str) -> DataFrame:
    """Contexts whose file and search paths are relative to the root, worked out against the entry's directory.

    Entries of files outside the root, and search paths that leave it, can't name
    a file of the workspace and are left out.
    """
    top = root.removeprefix("file://").strip("/") + "/"

    def below(path: Column) -> Column:
        whole = joined(F.when(F.startswith(path, F.lit("/")), F.lit("")).otherwise(F.coalesce("directory", F.lit(""))), path)
        return F.when(F.concat(whole, F.lit("/")) == top, F.lit("")).when(F.startswith(whole, F.lit(top)), F.substring(whole, len(top) + 1, 1 << 30))

    out = contexts.withColumns({k: F.filter(F.transform(k, below), lambda p: p.isNotNull()) for k in SEARCH_ORDER})
    return out.withColumn("file", below(F.col("file"))).filter("file is not null")


def search_paths(contexts: DataFrame) -> DataFrame:
    """(file, paths): the file's own directory, then every search path in order, first mention kept; of several entries of a file the first in order of their paths."""
    own = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    listed = contexts.select("file", F.array_distinct(F.concat(F.array(own), *SEARCH_ORDER)).alias("paths"))
    return listed.groupBy("file").agg(F.min("paths").alias("paths"))


def macro_values(contexts: DataFrame) -> DataFrame:
    """(file, name, value) of macros that are defined in the end: the last -D or -U of a name counts."""
    each = contexts.select("file", F.posexplode("macros").alias("_n", "m"))
    last = each.groupBy("file", F.col("m.name").alias("name")).agg(F.max_by("m", "_n").alias("m"))
    return last.filter("m.defined").select("file", "name", F.col("m.value").alias("value"))


def path_maps(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, target, position, base): the ``paths`` of a TypeScript project, longest pattern first."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>", {"allowComments": "true"})["compilerOptions"].alias("o"))
    each = raw.select(F.coalesce("o.baseUrl", F.lit(".")).alias("base"), F.explode("o.paths").alias("pattern", "targets"))
    return each.select("pattern", F.posexplode("targets").alias("position", "target"), "base").orderBy(F.desc(F.length("pattern")), "pattern", "position")


def go_module(spark: SparkSession, path: str) -> str | None:
    """The module name of a ``go.mod``."""
    row = spark.read.text(path).filter(F.col("value").rlike(r"^\s*module\s+\S")).select(F.regexp_extract("value", r"^\s*module\s+(\S+)", 1).alias("m")).first()
    return row["m"] if row else None


def settings(spark: SparkSession, root: str) -> dict:
    """What the project files at a root say: ``search`` paths, a Go ``module`` and path ``maps``, as an index run takes them; null without the file."""
    at = lambda name: f"{root.rstrip('/')}/{name}" if capture(root, name)[0] else None
    commands, go, script = at("compile_commands.json"), at("go.mod"), at("tsconfig.json")
    return {
        "search": search_paths(rebased(compile_commands(spark, commands), root)) if commands else None,
        "module": go_module(spark, go) if go else None,
        "maps": path_maps(spark, script).collect() if script else None,  # one project file's entries
    }
