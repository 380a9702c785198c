"""Column functions over text: tokens, names, signatures, scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: everything but letters and numbers.
TOKEN_GAP = r"[^\p{L}\p{N}]+"
#: Letters with a mark, and the letter each becomes without it.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
BARE = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def fold(text: Column) -> Column:
    """Lower case without diacritics, whether letter and mark are one character or two."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), MARKED, BARE)


def tokens(text: Column, folded: bool = False) -> Column:
    """Lower-cased words of letters and numbers, in order; null text has none."""
    lowered = fold(text) if folded else F.lower(text)
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), TOKEN_GAP, -1), lambda t: t != "")


def scope_hierarchy(scope: Column, delimiter: str = ".") -> Column:
    """The scope, each scope around it, and last the empty scope, innermost first."""
    parts = F.filter(F.split(F.coalesce(scope, F.lit("")), _literal(delimiter), -1), lambda p: p != "")
    around = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), delimiter))
    return F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(F.array_append(around, F.lit("")))


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def symbol_key(language: Column, path: Column, kind: Column, qualified_name: Column, signature: Column | None = None) -> Column:
    """``language:path#kind#name`` and, where there is one, ``#signature``; without an offset, so edits keep it."""
    key = F.concat(language, F.lit(":"), path, F.lit("#"), kind, F.lit("#"), qualified_name)
    if signature is None:
        return key
    return F.when(F.coalesce(signature, F.lit("")) == "", key).otherwise(F.concat(key, F.lit("#"), signature))


def without_nested(text: Column, open_: str, close: str) -> Column:
    """The text without bracketed parts, however deep: from the innermost out by patterns, and a walk where more levels are left."""
    inner = "\\" + open_ + "[^\\" + open_ + "\\" + close + "]*\\" + close
    for _ in range(4):
        text = F.regexp_replace(text, inner, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        inside = (acc["depth"] > 0) & (c == close)
        return F.struct(
            F.when(c == open_, acc["depth"] + 1).when(inside, acc["depth"] - 1).otherwise(acc["depth"]).alias("depth"),
            F.when((c == open_) | inside | (acc["depth"] > 0), acc["kept"]).otherwise(F.concat(acc["kept"], c)).alias("kept"),
        )

    walked = lambda t: F.aggregate(F.split(t, ""), start, step, lambda acc: acc["kept"])
    # a one-element array binds the text to a name, so that calls within calls don't multiply
    return F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit(open_)) & F.contains(t, F.lit(close)), walked(t)).otherwise(t))[0]


def parameters(signature: Column) -> Column:
    """What stands between the first ``(`` and the last ``)``; null without parentheses."""
    inside = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    return F.when(signature.rlike(r"(?s)\(.*\)"), F.trim(inside))


def arity(signature: Column) -> Column:
    """Number of parameters: commas outside brackets, plus one; none for ``void`` or nothing; null without parentheses."""
    inside = parameters(signature)
    flat = inside
    for open_, close in ("()", "<>", "[]", "{}"):
        flat = without_nested(flat, open_, close)
    commas = F.length(flat) - F.length(F.replace(flat, F.lit(","), F.lit("")))
    return F.when(inside.isNull(), None).when(inside.isin("", "void"), 0).otherwise(commas + 1).cast("int")


def normal_signature(signature: Column) -> Column:
    """Parameter types only, single blanks: ``(const int x, char  c)`` becomes ``(const int,char)``."""
    inside = F.regexp_replace(F.coalesce(parameters(signature), F.lit("")), r"\s+", " ")
    outer = F.split(inside, r",(?![^<>]*>)(?![^()]*\))", -1)  # not at commas inside brackets
    named = F.transform(outer, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"\s*=.*$", ""), r"^(.*[\s*&>\]])[A-Za-z_]\w*$", "$1"))
    return F.concat(F.lit("("), F.array_join(F.transform(named, lambda p: F.trim(p)), ","), F.lit(")"))


def looks_like_interface(name: Column, qualified_name: Column, signature: Column) -> Column:
    """Pure virtual, virtual without override, or a name of the form ``IName``."""
    s = F.coalesce(signature, F.lit(""))
    return s.contains("= 0") | (s.contains("virtual") & ~s.contains("override")) | name.rlike("^I[A-Z]") | F.coalesce(qualified_name, F.lit("")).contains("::I")


def dotted_name(name: Column) -> Column:
    """A C# name in plain dotted form: no ``global::``, generics, ``?``, ``*`` or ``[]``; ``::`` becomes a dot."""
    bare = F.regexp_replace(without_nested(F.regexp_replace(name, r"^global::", ""), "<", ">"), r"[?*]|\[[^\]]*\]", "")
    return F.replace(bare, F.lit("::"), F.lit("."))


def is_dynamic(path: Column) -> Column:
    """Whether a shell path is only known when the script runs."""
    return path.rlike(r"[$`{}]")


def unquote(text: Column) -> Column:
    """Without surrounding blanks, then quotes or angle brackets."""
    return F.regexp_replace(F.trim(text), "^(?:\"(.*)\"|'(.*)'|<(.*)>)$", "$1$2$3")


def module_path(name: Column) -> Column:
    """A dotted module name as a path."""
    return F.replace(name, F.lit("."), F.lit("/"))


def modifier_mask(modifiers: Column, legend: list[str]) -> Column:
    """Names to a bit mask, bit i for the legend's i-th name; unknown names have none."""
    bits = F.create_map(*(x for i, m in enumerate(legend) for x in (F.lit(m), F.lit(1 << i))))
    return F.aggregate(F.array_distinct(modifiers), F.lit(0), lambda acc, m: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, m), F.lit(0))))


def mask_modifiers(mask: Column, legend: list[str]) -> Column:
    """A bit mask back to names, in the legend's order."""
    names = F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(m)) for i, m in enumerate(legend)))
    return F.filter(names, lambda n: n.isNotNull())


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def byte_size(n: Column) -> Column:
    """Bytes in a form for people: ``512 B``, ``1.5 KB``, ``2.0 MB``."""
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024.0**2))
        .otherwise(F.format_string("%.1f GB", n / 1024.0**3))
    )


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of settings; arrays joined by commas, parts by pipes."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
