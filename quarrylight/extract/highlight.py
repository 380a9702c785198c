"""Comments, strings, numbers, keywords and operators of a text, for display; linear in the text."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.extract import lexer
from quarrylight.extract.facts import Facts

#: The words each language reserves.
KEYWORDS = {
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while",
    "cpp": "alignas alignof auto bool break case catch char class co_await co_return co_yield concept const consteval constexpr constinit const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false final float for friend goto if inline int long mutable namespace new noexcept nullptr operator override private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while",
    "csharp": "abstract as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach get goto if implicit in init int interface internal is lock long namespace new null object operator out override params private protected public readonly record ref return sbyte sealed set short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using var virtual void volatile where while yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public record return sealed short static strictfp super switch synchronized this throw throws transient true try var void volatile while yield",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield",
    "typescript": "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let module namespace never new null number object of private protected public readonly return set static string super switch symbol this throw true try type typeof undefined unknown var void while with yield",
    "go": "break case chan const continue default defer else fallthrough false for func go goto if import interface iota map nil package range return select struct switch true type var",
    "shell": "case do done elif else esac export fi for function if in local readonly return select then time until while",
}
KEYWORDS["bash"] = KEYWORDS["shell"] + " declare source typeset"
KEYWORDS["python"] = " ".join([*keyword.kwlist, *keyword.softkwlist])

_WORD = r"(?P<id>[^\W\d]\w*)|(?P<number>\d[\w.]*)"
_TRIPLE = r'[rRbBuUfFtT]{0,2}(?:""".*?(?:"""|\Z)|\'\'\'.*?(?:\'\'\'|\Z))'
_PLAIN = r'[rRbBuUfFtT]{0,2}(?:"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|\'(?:\\.|[^\'\\\n])*(?:\'|(?=\n)|\Z))'
_OTHERS = {
    "python": rf"(?P<comment>\#[^\n]*)|(?P<string>{_TRIPLE}|{_PLAIN})|{_WORD}|(?P<op>\*\*|//|->|:=|[-+*/%@&|^~<>=!]=?)",
    "shell": rf"(?P<comment>(?:(?<=[\s;])|\A)\#[^\n]*)|(?P<string>\"(?:\\.|[^\"\\])*(?:\"|\Z)|'[^']*(?:'|\Z))|(?P<skip>\$\#|\\.)|{_WORD}|(?P<op>&&|\|\||;;|>>|<<|[|&<>])",
}
_OTHERS["bash"] = _OTHERS["shell"]
_COMPILED = {language: re.compile(pattern, re.DOTALL | re.MULTILINE) for language, pattern in _OTHERS.items()}
_TYPES = {"comment": "comment", "string": "string", "number": "number", "directive": "macro", "op": "operator"}
_BRACKETS = set("()[]{},;.")
TOKENS = "start_line int, start_column int, length bigint, type string"


def tokens(text: str, language: str) -> Iterator[tuple[int, int, int, str]]:
    """(line, byte column, byte length, type); a token over several lines gives one of each line.

    A text of a language that isn't known gives none.
    """
    if language not in KEYWORDS:
        return
    words = set(KEYWORDS[language].split())
    pattern = _COMPILED[language] if language in _COMPILED else lexer._pattern(language)
    regexes = language in ("javascript", "typescript")
    places, at, seen, byte, last = Facts(text), 0, 0, 0, ""
    while m := pattern.search(text, at):
        kind, at = m.lastgroup, m.end()
        if regexes and m[0] == "/" and (not last or last in lexer._BEFORE_REGEX) and (r := lexer._REGEX.match(text, m.start())):
            m, at, kind = r, r.end(), "regexp"
        if kind == "id":
            shown = "keyword" if m[0] in words else None
        elif kind == "op" and m[0] in _BRACKETS:
            shown = None
        else:
            shown = "regexp" if kind == "regexp" else _TYPES.get(kind)
        if kind not in ("comment", "line"):
            last = m[0]
        if shown is None:
            continue
        byte, seen = byte + len(text[seen : m.start()].encode()), m.start()
        start = byte
        for part in m[0].split("\n"):
            size = len(part.encode())
            if size:
                place = places.place(start, start)
                yield place["start_line"], place["start_column"], size, shown
            start += size + 1


def lexical(files: DataFrame) -> DataFrame:
    """(language, text) to the tokens of each text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("start_line", pa.int32()), ("start_column", pa.int32()), ("length", pa.int64()), ("type", pa.string())])
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(tokens(text or "", language))
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return files.select("language", "text").mapInArrow(run, TOKENS)
