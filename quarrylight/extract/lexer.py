"""Tokens of brace languages, in one pass whose time is linear in the text.

Comments vanish, strings and preprocessor lines are one token each, and every
bracket knows its partner.
"""

from __future__ import annotations

import re

ID, NUMBER, STRING, OP, LINE, DIRECTIVE = "id", "number", "string", "op", "line", "directive"

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)' + r"|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_BLOCK = r'""".*?(?:"""|\Z)|'
_VERBATIM = r'\$?@\$?"(?:""|[^"])*(?:"|\Z)|'
_TEMPLATE = r"`(?:\\.|[^`\\])*(?:`|\Z)|"
_RAW = r"`[^`]*(?:`|\Z)|"
_CPP_RAW = r'R"\((?s:.*?)(?:\)"|\Z)|'
_STRINGS = {"c": "", "cpp": _CPP_RAW, "csharp": _BLOCK + _VERBATIM, "java": _BLOCK, "javascript": _TEMPLATE, "typescript": _TEMPLATE, "go": _RAW}
_OPERATOR = r"=>|->|::|\.\.\.|:=|&&|\|\||==|!=|<=|>=|\?\.|\+\+|--|[^\s\w]"
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_PATTERNS: dict[str, re.Pattern] = {}
#: After these a slash begins a regular expression.
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; => && || == != return typeof case".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}


def _pattern(language: str) -> re.Pattern:
    if language not in _PATTERNS:
        directive = r"(?P<directive>^[ \t]*\#(?:\\\r?\n|[^\n])*)|" if language in ("c", "cpp", "csharp") else ""
        strings = _STRINGS[language] + _QUOTED
        _PATTERNS[language] = re.compile(rf"(?P<comment>{_COMMENT})|{directive}(?P<string>{strings})|(?P<id>(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<op>{_OPERATOR})", re.DOTALL | re.MULTILINE)
    return _PATTERNS[language]


class Tokens:
    """Kinds, texts, places and partners of a text's tokens."""

    def __init__(self, text: str, language: str):
        self.kind: list[str] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        find, at, last, regexes = _pattern(language).search, 0, "", language in ("javascript", "typescript")
        while m := find(text, at):
            at = m.end()
            kind = m.lastgroup
            if kind == "comment":
                continue
            if regexes and m[0] == "/" and (not last or last in _BEFORE_REGEX) and (r := _REGEX.match(text, m.start())):
                m, at, kind = r, r.end(), STRING
            self.kind.append(kind)
            self.text.append(m[0])
            self.start.append(m.start())
            self.end.append(m.end())
            if kind != LINE:
                last = m[0]
        self.partner, self.unbalanced = self._partners()

    def __len__(self) -> int:
        return len(self.kind)

    def _partners(self) -> tuple[dict[int, int], int]:
        """Opening to closing places and back; how many braces more are opened (or, below 0, closed) than have a partner."""
        partner, stack, stray = {}, [], 0
        for i, t in enumerate(self.text):
            if self.kind[i] != OP:
                continue
            if t in "([{":
                stack.append(i)
            elif t in _CLOSES:
                while stack and self.text[stack[-1]] != _CLOSES[t] and t == "}":
                    stack.pop()  # a brace ends what was left open inside
                if stack and self.text[stack[-1]] == _CLOSES[t]:
                    partner[i] = stack.pop()
                    partner[partner[i]] = i
                elif t == "}":
                    stray -= 1
        return partner, stray + sum(self.text[i] == "{" for i in stack)
