"""Facts of shell scripts: variables, functions, aliases, sourced files and the commands that are run."""

from __future__ import annotations

import re
from itertools import accumulate

from quarrylight.extract.facts import Facts

SEEN = 0.6
_TOKEN = re.compile(
    r"(?P<skip>\\.|[ \t]+)|(?P<heredoc><<-?[ \t]*(?P<quote>['\"]?)(?P<mark>[A-Za-z_]\w*)(?P=quote))|(?P<open>\$\(\(|\$\(|<\(|>\(|`)|(?P<sep>\n|;;|&&|\|\||[;&|()])"
    r"|(?P<single>\$?'(?:[^'])*'?)|(?P<double>\"(?:\\.|[^\"\\])*\"?)|(?P<param>\$\{[^}\n]*\}?|\$\w+|\$.)|(?P<redirect>\d*[<>]+&?\d*)|(?P<word>[^\s;&|()<>`\"'$\\]+)",
    re.DOTALL,
)
#: Words after which a command may begin, and words that begin none.
STARTERS = set("if then else elif do while until ! time { }".split())
ENDERS = set("fi done esac".split())
DECLARING = set("export local readonly declare typeset".split())
_ASSIGNED = re.compile(r"([A-Za-z_]\w*)(?:\[[^\]]*\])?\+?=")


def extract(text: str, path: str) -> Facts:
    facts = Facts(text)
    ends = None if text.isascii() else [0, *accumulate(len(c.encode()) for c in text)]
    byte = (lambda i: i) if ends is None else ends.__getitem__
    #: Open functions: name, the closing word, and how deep it lies.
    scopes: list[tuple[str, str, int, int]] = []
    waiting: list[str] = []
    command, loop, words, pending, at, braces, parens, function_word = True, False, [], "", 0, 0, 0, False
    named: tuple[str, int, int] | None = None
    glued = -1

    def scope() -> str:
        return scopes[-1][0] if scopes else ""

    def symbol(name: str, kind: str, start: int, inside: str) -> None:
        facts.symbol(name, kind, inside, byte(start), byte(start + len(name)))

    def inner(piece: str, start: int) -> None:
        """Commands substituted inside double quotes."""
        for m in re.finditer(r"(?:\$\(\s*(?!\()|(?:&&|\|\||[;|])\s*(?=[^\"]*\)))([A-Za-z_][\w./-]*)|`\s*([A-Za-z_][\w./-]*)(?=[^`]*`)", piece):
            g = 1 if m[1] else 2
            facts.occurrence(m[g], "call", scope(), byte(start + m.start(g)), byte(start + m.end(g)), SEEN)

    n = len(text)
    while at < n:
        if text[at] == "#" and glued != at:
            stop = text.find("\n", at)
            at = n if stop < 0 else stop
            continue
        m = _TOKEN.match(text, at)
        if m is None:
            at += 1
            continue
        start, at, kind, piece = at, m.end(), m.lastgroup, m[0]
        if kind in ("mark", "quote", "heredoc"):
            waiting.append(m["mark"])
        elif kind == "skip":
            if piece[0] == "\\":
                glued = at
        elif kind == "open":
            command = piece != "$(("
            parens += piece.count("(")
        elif kind == "sep":
            if piece == "\n" and waiting:
                for mark in waiting:
                    end = re.compile(rf"^[ \t]*{re.escape(mark)}[ \t]*$", re.MULTILINE).search(text, at)
                    at = end.end() if end else n
                waiting = []
            if piece == "(":
                if named or (command is False and len(words) == 1 and glued == start and re.match(r"\s*\)", text[at:])):
                    if not named:
                        name, where = words[0]
                        facts.occurrences.pop()
                        named = (name, where, start)
                        at = text.index(")", at) + 1
                        command = True
                        continue
                    if text[at : at + 1] == ")":
                        at += 1
                        continue
                    scopes.append((named[0], ")", parens, named[1]))
                    named = None
                parens += 1
                command = True
            elif piece == ")":
                parens = max(parens - 1, 0)
                if scopes and scopes[-1][1] == ")" and scopes[-1][2] == parens:
                    name, _, _, where = scopes.pop()
                    facts.symbol(name, "function", "", byte(where), byte(where + len(name)), (byte(where), byte(at)))
                command = False
            else:
                command, loop, words, pending = True, False, [], ""
        elif kind == "word":
            whole = glued != start
            glued = at
            if not whole:
                continue
            if pending in DECLARING or pending == "alias":
                if pending == "alias" and (a := re.match(r"([\w.-]+)=", piece)):
                    symbol(a[1], "macro", start, "")
                elif pending != "alias" and re.match(r"[A-Za-z_]\w*", piece):
                    symbol(re.match(r"[A-Za-z_]\w*", piece)[0], "variable", start, scope())
                continue
            if pending in ("source", "."):
                facts.occurrence(piece, "import", scope(), byte(start), byte(at), SEEN)
                pending = ""
                continue
            if function_word:
                named, function_word, command = (piece.rstrip("()"), start, at), False, True
                continue
            if not command or loop:
                if loop and piece in ("in", "do"):
                    loop = piece != "do"
                    command = piece == "do"
                continue
            if piece == "{":
                braces += 1
                if named:
                    scopes.append((named[0], "}", braces, named[1]))
                    named = None
            elif piece == "}":
                if scopes and scopes[-1][1] == "}" and scopes[-1][2] == braces:
                    name, _, _, where = scopes.pop()
                    facts.symbol(name, "function", "", byte(where), byte(where + len(name)), (byte(where), byte(at)))
                braces = max(braces - 1, 0)
            elif piece in STARTERS:
                pass
            elif piece in ENDERS:
                command = False
            elif piece in ("for", "case", "select"):
                loop = True
            elif piece == "function":
                function_word = True
            elif a := _ASSIGNED.match(piece):
                symbol(a[1], "variable", start, scope())
            else:
                command, words = False, [(piece, start)]
                pending = piece if piece in DECLARING or piece in ("alias", "source", ".") else ""
                if not pending and re.match(r"[A-Za-z_./~][\w./+-]*$", piece):
                    facts.occurrence(piece, "call", scope(), byte(start), byte(at), SEEN)
                elif not pending:
                    words = []
        else:
            if kind == "double":
                if pending in ("source", "."):
                    dynamic = "$" in piece
                    facts.occurrence(piece.strip('"'), "import", scope(), byte(start), byte(at), 0.0 if dynamic else SEEN, metadata='{"dynamic": true}' if dynamic else None)
                    pending = ""
                inner(piece, start)
            elif kind == "param" and pending in ("source", "."):
                stop = re.compile(r"[\s;&|]|\Z").search(text, at).start()
                facts.occurrence(text[start:stop], "import", scope(), byte(start), byte(stop), 0.0, metadata='{"dynamic": true}')
                at, pending = stop, ""
            if command and kind != "redirect" and glued != start:
                command = False
            glued = at
    for name, _, _, where in scopes:
        facts.symbol(name, "function", "", byte(where), byte(where + len(name)), (byte(where), byte(n)))
    return facts
