"""Source trees as tables: listing, ignore rules, globs, languages, content.

Spark's own file source hides names that begin with ``_`` or ``.``, which a source
tree needs, so the tree is listed through Arrow's file systems (local, HDFS, S3
and the like).  The listing has names and sizes only and a fixed limit; ignore
rules become regular expressions over its paths; what remains is read on the
executors, each file where its row is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight import schema

#: Directory and file names that are never indexed.
DEFAULT_IGNORED = [".git", "node_modules", "build", "dist", "target", "vendor", ".cache"]
IGNORE_FILES = (".gitignore", ".indexignore")
MAX_FILES, MAX_DEPTH, MAX_BYTES = 1_000_000, 64, 32 << 20
SNIFF_BYTES, FULL_SNIFF_BYTES = 1024, 8192


def glob_regex(glob: str) -> str:
    """``*`` within a name, ``**`` across names, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes win; without includes everything else is in."""
    any_of = lambda globs: F.greatest(*(path.rlike(glob_regex(g)) for g in globs), F.lit(False))
    inside = any_of(include) if include else F.lit(True)
    return inside & ~any_of(exclude) if exclude else inside


def ignore_rules(text: str, directory: str = "") -> list[tuple[str, bool]]:
    """An ignore file's lines to (regex over relative paths, whether it ignores), in order.

    A rule holds below the file's directory; ``!`` takes back, a slash inside
    anchors, a slash at the end means directories only.
    """
    rules = []
    base = re.escape(directory.strip("/") + "/") if directory.strip("/") else ""
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only_directory = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))[1:-1]
        start = f"^{base}" if anchored else f"^{base}(?:.*/)?"
        rules.append((f"{start}{body}/.*$" if only_directory else f"{start}{body}(?:/.*)?$", not negated))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides; neighbours of one verdict are one expression, so many rules stay a flat plan."""
    out = F.lit(False)
    for hides, run in groupby(rules, key=lambda rule: rule[1]):
        out = F.when(path.rlike("|".join(f"(?:{regex})" for regex, _ in run)), F.lit(hides)).otherwise(out)
    return out


def default_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, DEFAULT_IGNORED)))


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def list_tree(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, path, size, mtime) of the files below a root, without directories that are ignored by name.

    Links are followed where they stay below the root; a link to a directory
    that is listed already adds nothing, so circles end, and real directories go
    first, so what a path is called doesn't depend on the order of names.  Broken
    links and links out of the root are left out.  Too many files or levels are
    an error, not a silent cut.
    """
    from pyarrow import fs

    system, base = _file_system(root)
    local = isinstance(system, fs.LocalFileSystem)
    rows, front, links, listed = [], [(base, 0)], [], set()
    while front or links:
        directory, depth = front.pop() if front else links.pop(0)
        if depth > max_depth:
            raise ValueError(f"more than {max_depth} levels below {root}")
        if local:
            if (real := os.path.realpath(directory)) in listed:
                continue
            listed.add(real)
        for info in sorted(system.get_file_info(fs.FileSelector(directory)), key=lambda i: i.path):
            if info.base_name in DEFAULT_IGNORED:
                continue
            link = local and os.path.islink(info.path)
            if link and not _inside(base, info.path):
                continue
            if info.type == fs.FileType.Directory:
                (links if link else front).append((info.path, depth + 1))
            elif info.type == fs.FileType.File:
                rows.append((root, info.path[len(base) :].lstrip("/"), info.size, info.mtime or datetime.fromtimestamp(0, UTC)))
                if len(rows) > max_files:
                    raise ValueError(f"more than {max_files} files below {root}")
    parts = max(1, min(len(rows) // 64, 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(sorted(rows), "root string, path string, size bigint, mtime timestamp").repartition(parts, "path")


def _inside(base: str, path: str) -> bool:
    """Whether a local path, all links followed, is below the base."""
    top = os.path.realpath(base)
    return os.path.realpath(path).startswith(top.rstrip("/") + "/")


def capture(root: str, path: str, max_bytes: int | None = None) -> tuple[bytes | None, str | None]:
    """A file's content, or the code of what keeps it from being read."""
    from pyarrow import fs

    system, base = _file_system(root)
    full = f"{base.rstrip('/')}/{path}"
    try:
        if isinstance(system, fs.LocalFileSystem) and not _inside(base, full):
            return None, "file.outside"
        before = system.get_file_info(full)
        if max_bytes is not None and before.size is not None and before.size > max_bytes:
            return None, "file.too_large"
        with system.open_input_stream(full) as f:
            content = f.read()
        after = system.get_file_info(full)
    except OSError:
        return None, "file.unreadable"
    return (content, None) if (before.size, before.mtime) == (after.size, after.mtime) else (None, "file.changed")


def _read(max_bytes: int | None):
    """Adds the content or why there is none, a bounded amount of it per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, codes, size, lo = [], [], 0, 0
            for i, (root, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                content, code = capture(root, path, max_bytes)
                held.append(content)
                codes.append(code)
                size += len(content or b"")
                if size > 32 << 20 or i == batch.num_rows - 1:
                    part = batch.slice(lo, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(held, pa.binary()), pa.array(codes, pa.string())], ["path", "size", "mtime", "content", "error"])
                    held, codes, size, lo = [], [], 0, i + 1

    return run


def discover(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH, max_bytes: int | None = MAX_BYTES, overrides: dict[str, str] | None = None, headers: str | None = None, extensionless: str | None = None) -> DataFrame:
    """The files that are to be indexed: path, size, mtime, content, error, language, hash and whether they are binary.

    A file that can't be read, or is larger than max_bytes, has no content but an
    error's code.
    """
    listed = list_tree(spark, root, max_files, max_depth)
    named = listed.filter(F.element_at(F.split("path", "/"), -1).isin(*IGNORE_FILES)).select("path").collect()  # within the listing's limit
    system, base = _file_system(root)
    rules: list[tuple[str, bool]] = []
    for path in sorted((r["path"] for r in named), key=lambda p: (p.count("/"), p)):
        with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
            rules += ignore_rules(f.read().decode(errors="replace"), path.rpartition("/")[0])
    kept = listed.filter(~default_ignored(F.col("path")) & ~ignored(F.col("path"), rules) & included(F.col("path"), include or [], exclude or []))
    files = kept.mapInArrow(_read(max_bytes), "path string, size bigint, mtime timestamp, content binary, error string")
    return with_language(files, overrides, headers, extensionless).withColumns({"content_hash": F.sha2("content", 256), "is_binary": F.coalesce(is_binary(F.col("content")), F.lit(False))})


def has_nul(content: Column, n: int = SNIFF_BYTES) -> Column:
    """Whether a NUL is among the first bytes."""
    return F.hex(F.substring(content, F.lit(1), F.lit(n))).rlike("^(?:[0-9A-F]{2})*?00")


def is_binary(content: Column) -> Column:
    """A NUL in the first bytes, or bytes that aren't UTF-8."""
    return has_nul(content, FULL_SNIFF_BYTES) | ~F.is_valid_utf8(content.cast("string"))


def text_of(content: Column) -> Column:
    """Content as text, without a byte-order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def shebang(content: Column) -> Column:
    """The language that a first line names; null without one."""
    line = F.regexp_extract(F.decode(F.substring(content, F.lit(1), F.lit(256)), "UTF-8"), r"^#!\s*(\S+)(?:\s+(?:-\S+\s+)*(\S+))?", 0)
    program = F.regexp_extract(line, r"^#!\s*\S*/(?:env\s+(?:-\S+\s+)*)?([A-Za-z]+)[0-9.]*(?:\s|$)", 1)
    known = F.create_map(*(x for k, v in schema.INTERPRETERS.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(known, program)


def with_language(files: DataFrame, overrides: dict[str, str] | None = None, headers: str | None = None, extensionless: str | None = None) -> DataFrame:
    """Language by path override, extension override, header rules, extension, first line, else unknown.

    overrides maps globs over paths, or ``.ext``, to languages; headers sets the
    language of all ``.h`` files, extensionless that of names without a dot.
    """
    overrides = overrides or {}
    path = F.col("path")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_path = F.coalesce(*(F.when(path.rlike(glob_regex(g)), F.lit(v)) for g, v in overrides.items() if not g.startswith(".")), F.lit(None).cast("string"))
    by_override = F.coalesce(*(F.when(extension == g[1:].lower(), F.lit(v)) for g, v in overrides.items() if g.startswith(".")), F.lit(None).cast("string"))
    known = F.create_map(*(x for k, v in schema.EXTENSIONS.items() for x in (F.lit(k), F.lit(v))))
    typed = files.withColumns({"_ext": extension, "_set": F.coalesce(by_path, by_override)})
    if headers:
        joined = typed.withColumn("_header", F.when(F.col("_ext") == "h", F.lit(headers)))
    else:
        joined = typed.join(header_languages(typed), "path", "left")
    return joined.withColumn("language", F.coalesce("_set", "_header", F.try_element_at(known, F.col("_ext")), shebang(F.col("content")), F.when(F.col("_ext") == "", F.lit(extensionless)), F.lit("unknown"))).drop("_ext", "_set", "_header")


def header_languages(files: DataFrame) -> DataFrame:
    """(path, _header) of ``.h`` files: by a source of the same stem beside it, then anywhere, then what the project holds, then its content."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    directory = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    cpp = ["cc", "cpp", "cxx", "c++"]
    sources = files.filter(F.col("_ext").isin("c", *cpp)).select(stem.alias("_stem"), directory.alias("_dir"), F.col("_ext").isin(cpp).alias("_cpp"))
    beside = sources.groupBy("_stem", "_dir").agg(F.max("_cpp").alias("_b"))
    anywhere = sources.groupBy("_stem").agg(F.max("_cpp").alias("_a"))
    totals = sources.agg(F.count_if("_cpp").alias("cpp"), F.count_if(~F.col("_cpp")).alias("c")).first()
    only_cpp = totals["cpp"] > 0 and totals["c"] == 0
    headers = files.filter(F.col("_ext") == "h").select("path", stem.alias("_stem"), directory.alias("_dir"), F.decode(F.substring("content", F.lit(1), F.lit(65536)), "UTF-8").alias("_text"))
    looks = F.col("_text").rlike(r"(?m)^\s*(class|namespace|template\s*<|using\s|public:|private:|protected:)|::|\bconstexpr\b|\bnullptr\b")
    name = lambda c: F.when(c, "cpp").otherwise("c")
    return headers.join(beside, ["_stem", "_dir"], "left").join(anywhere, "_stem", "left").select("path", F.coalesce(F.when(F.col("_b").isNotNull(), name(F.col("_b"))), F.when(F.col("_a").isNotNull(), name(F.col("_a"))), F.lit("cpp") if only_cpp else F.lit(None), name(looks)).alias("_header"))


def failed(files: DataFrame) -> DataFrame:
    """Files that can't be read as text, as diagnostics; their old index stays."""
    says = {"file.binary": "binary or not UTF-8", "file.too_large": "larger than the limit", "file.unreadable": "can't be read", "file.changed": "changed while it was read", "file.outside": "leads out of the root"}
    code = F.when(F.col("is_binary"), F.lit("file.binary")).otherwise(F.col("error"))
    messages = F.create_map(*(F.lit(x) for pair in says.items() for x in pair))
    return files.filter("is_binary or error is not null").select("path", F.lit("error").alias("severity"), F.lit("filesystem").alias("source"), code.alias("code"), messages[code].alias("message"))


def latest_per_path(files: DataFrame) -> DataFrame:
    """One row per path, the newest, where several captures are at hand."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime"), "content_hash"))).filter("_n = 1").drop("_n")
