"""Where an import leads: candidate paths per language, of which the first known one wins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import paths

#: Endings that are tried for a module of each language.
ENDINGS = {
    "python": [".py", ".pyi", "/__init__.py"],
    "typescript": ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"],
    "javascript": ["", ".js", ".jsx", ".mjs", ".cjs", ".ts", "/index.js", "/index.jsx"],
    "java": [".java"],
}
#: Fixed value: the folder below which a Java package may begin.
JAVA_ROOT = "src/"


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def joined(base: Column, name: Column) -> Column:
    """``base/name`` with ``.`` and ``..`` worked out; null where it leads above the root."""
    parts = F.filter(F.split(F.concat_ws("/", base, name), "/", -1), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("above"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        return F.struct(
            F.when(~up, F.array_append(acc["at"], part)).otherwise(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).alias("at"),
            (acc["above"] | (up & (F.size(acc["at"]) == 0))).alias("above"),
        )

    walked = F.aggregate(parts, start, step)
    return F.when(~walked["above"], F.array_join(walked["at"], "/"))


def mapped(name: Column, maps: list) -> Column:
    """What path maps (pattern, target, base), in their order, make of a name; a ``*`` stands for the rest of it.

    The maps are one array of the plan, however many there are.
    """
    rows = []
    for pattern, target, base in ((m["pattern"], m["target"], m["base"]) for m in maps):
        star = pattern.endswith("*")
        head, found, tail = target.partition("*") if star else (target, "", "")
        rows.append({"key": pattern[:-1] if star else pattern, "star": star, "head": head, "fill": bool(found), "tail": tail, "base": base})
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<key:string,star:boolean,head:string,fill:boolean,tail:string,base:string>>")
    fits = F.filter(listed, lambda m: F.when(m["star"], F.startswith(name, m["key"])).otherwise(name == m["key"]))
    rest = lambda m: F.when(m["fill"], F.substring(name, F.length(m["key"]) + 1, F.length(name))).otherwise("")
    return F.transform(fits, lambda m: joined(m["base"], F.concat(m["head"], rest(m), m["tail"])))


def candidates(language: Column, source: Column, raw: Column, search: Column | None = None, module: str | None = None, maps: list | None = None) -> Column:
    """Ordered candidate paths of an import; an empty array where the language has none.

    C and C++ look beside the file unless the name is in angle brackets, then
    along the search paths; Python resolves leading dots against the package;
    TypeScript and JavaScript probe endings, of what the path maps give before the
    name itself; Go strips the module's name; Java turns dots into slashes, from
    the root and from ``src``; shells look beside the file, then at the root.
    """
    here, name = directory(source), text.unquote(raw)
    empty = F.array().cast("array<string>")
    where = F.coalesce(search, empty) if search is not None else empty
    quoted = ~F.trim(raw).startswith("<")
    include = F.concat(F.when(quoted, F.array(joined(here, name))).otherwise(empty), F.transform(where, lambda p: joined(p, name)), F.array(name))
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = text.module_path(F.regexp_replace(name, r"^\.+", ""))
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/")
    base = F.when(dots > 0, joined(here, F.concat_ws("/", F.when(dots > 1, up), rest))).otherwise(rest)
    parent = F.regexp_extract(base, r"^(.*)/[^/]*$", 1)
    endings = lambda b, lang: [F.concat(b, F.lit(e)) for e in ENDINGS[lang]]
    # from package import name: the name may be a module or stand in its package
    python = F.array(*endings(base, "python"), *endings(parent, "python"))
    relative = F.when(name.startswith("."), joined(here, name)).otherwise(name)
    through = mapped(name, maps) if maps else empty

    def script(lang: str) -> Column:
        aliased = F.when(name.startswith("."), empty).otherwise(F.flatten(F.transform(through, lambda p: F.array(*endings(p, lang)))))
        return F.concat(aliased, F.array(*endings(relative, lang)))

    go = F.regexp_replace(name, "^" + (module or "").replace(".", r"\.") + "/?", "") if module else name
    java = text.module_path(F.regexp_replace(name, r"\.\*$", ""))
    shell = F.when(text.is_dynamic(name), empty).otherwise(F.array(joined(here, name), name))
    found = (
        F.when(language.isin("c", "cpp"), include)
        .when(language == "python", python)
        .when(language == "typescript", script("typescript"))
        .when(language == "javascript", script("javascript"))
        .when(language == "java", F.array(*endings(java, "java"), *endings(F.concat(F.lit(JAVA_ROOT), java), "java")))
        .when(language == "go", F.array(go))
        .when(language.isin("shell", "bash"), shell)
        .when(language == "csharp", empty)
        .otherwise(F.array(name))
    )
    return F.filter(found, lambda p: p.isNotNull() & (p != ""))


def resolve(imports: DataFrame, files: DataFrame, key: str, search: DataFrame | None = None, module: str | None = None, maps: list | None = None) -> DataFrame:
    """imports (key, path, language, raw_name) to (key, target_file_id, resolution, confidence, reason).

    By the ordered probes; a C or C++ header that no probe finds by the only
    path that ends in its name; a Go import by the files of its directory; what
    remains is external for a name that isn't relative, else unresolved.
    """
    rows = imports.join(search.select(F.col("file").alias("path"), "paths"), "path", "left") if search is not None else imports.withColumn("paths", F.lit(None).cast("array<string>"))
    probes = rows.withColumn("_probes", candidates(F.col("language"), F.col("path"), F.col("raw_name"), F.col("paths"), module, maps))
    known = files.select(F.col("path").alias("_known"), F.col("id").alias("_id"))
    first = paths.probe_first(probes, "_probes", known, "_known", key, "_id").select(key, F.col("_id").alias("_probed"), "probe")
    headers = rows.filter(F.col("language").isin("c", "cpp")).select(text.unquote(F.col("raw_name")).alias("_name"))
    suffix = paths.unique_suffix(headers, "_name", known, "_known", "_id").withColumnRenamed("_id", "_suffix")
    folders = files.filter(F.col("language") == "go").select(directory(F.col("path")).alias("_dir"), F.col("id")).groupBy("_dir").agg(F.min("id").alias("_folder"))
    out = rows.join(first, key, "left").withColumn("_name", text.unquote(F.col("raw_name"))).join(suffix, "_name", "left")
    short = F.regexp_replace("_name", "^" + (module or "").replace(".", r"\.") + "/?", "") if module else F.col("_name")
    out = out.withColumn("_dir", F.when(F.col("language") == "go", short)).join(folders, "_dir", "left")
    c_like = F.col("language").isin("c", "cpp")
    target = F.coalesce("_probed", F.when(c_like, F.col("_suffix")), "_folder")
    relative = F.col("_name").startswith(".") | text.is_dynamic(F.col("_name"))
    return out.select(
        key,
        target.alias("target_file_id"),
        F.when(target.isNotNull(), "resolved").when(relative, "unresolved").otherwise("external").alias("resolution"),
        F.when(F.col("_probed").isNotNull(), 1.0).when(target.isNotNull(), 0.8).otherwise(0.0).alias("confidence"),
        F.when(F.col("_probed").isNotNull(), "path").when(c_like & F.col("_suffix").isNotNull(), "suffix").when(F.col("_folder").isNotNull(), "directory").otherwise("none").alias("reason"),
    )
