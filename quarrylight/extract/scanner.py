"""Facts of brace languages, from their tokens.

There is no grammar here: statements are told apart by brackets, separators and
line ends, and what each declares by the words it begins with.  One pass, linear
in the text.  What such a scan sees is given a confidence of 0.6, and 0.5 for
calls on a receiver.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from itertools import accumulate

from quarrylight.extract.facts import Facts
from quarrylight.extract.lexer import DIRECTIVE, ID, LINE, NUMBER, OP, STRING, Tokens

SEEN, ON_RECEIVER = 0.6, 0.5
#: How far the other end of type arguments is looked for, in tokens.
ARGUMENTS = 200
#: Words that look like calls or declarations and are none, in all languages and in each.
ALWAYS = set("if for while switch return throw else do case goto try catch finally break continue".split())
CONTROL = {
    "c": ALWAYS | set("sizeof defined".split()), "cpp": ALWAYS | set("sizeof delete co_await co_return co_yield throw typeid defined".split()),
    "csharp": ALWAYS | set("sizeof typeof nameof lock foreach await yield using when is as in checked unchecked fixed default".split()), "java": ALWAYS | set("assert synchronized instanceof default yield".split()),
    "javascript": ALWAYS | set("await yield typeof instanceof delete of in void".split()), "typescript": ALWAYS | set("await yield typeof instanceof delete of in as is keyof satisfies".split()),
    "go": ALWAYS | set("go defer select range fallthrough".split()),
}
NOT_CALLS = set("function func def static_assert alignof decltype super this new import noexcept alignas void bool char short int long float double signed unsigned auto".split())
#: Words before a declaration that are no part of its type.
MODIFIERS = set("public private protected internal static final abstract virtual override async sealed synchronized partial extern native default readonly const constexpr consteval constinit inline explicit friend mutable volatile register thread_local export declare unsafe new required transient strictfp open".split())
TYPE_WORDS = {
    "c": {"struct", "union", "enum"}, "cpp": {"class", "struct", "union", "enum", "namespace"}, "csharp": {"class", "struct", "interface", "enum", "record", "namespace"},
    "java": {"class", "interface", "enum", "record"}, "javascript": {"class"}, "typescript": {"class", "interface", "enum", "namespace", "module"}, "go": set(),
}
KINDS = {"union": "struct", "record": "class", "module": "namespace"}
DELIMITER = {"c": "::", "cpp": "::"}
_IMPORTS = {
    "java": r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<name>[\w.*]+)[ \t]*;",
    "csharp": r"^[ \t]*(?P<global>global[ \t]+)?using[ \t]+(?P<static>static[ \t]+)?(?:(?P<alias>\w+)[ \t]*=[ \t]*)?(?P<name>[\w.]+)[ \t]*;",
}


@dataclass
class Context:
    """What a brace opened: its kind, the scope inside, and the statement that goes on after it."""

    kind: str
    scope: str
    head: list[int] = field(default_factory=list)
    depth: int = 0
    word: str = ""
    on: bool = False


def _import_options(found: re.Match) -> dict:
    """What an import says besides its name: an alias, and whether it opens a type or holds for every file."""
    groups = found.groupdict()
    return {name: groups[name] if name == "alias" else True for name in ("alias", "static", "global") if groups.get(name)}


class Scan:
    def __init__(self, text: str, path: str, language: str):
        self.text, self.path, self.language = text, path, language
        self.facts, self.t = Facts(text), Tokens(text, language)
        ends = None if text.isascii() else [0, *accumulate(len(c.encode()) for c in text)]
        self.byte = (lambda i: i) if ends is None else ends.__getitem__
        self.delimiter = DELIMITER.get(language, ".")
        self.control = CONTROL[language]
        self.spans: list[tuple[int, int, str]] = []
        self.taken: set[int] = set()
        self.owner: dict[str, str] = {}
        self.lines = language in ("go", "javascript", "typescript")

    # what a statement consists of
    def flat(self, head: list[int]) -> list[tuple[str, int]]:
        """(what, token) of a statement, brackets and type arguments as one item: an id's text, an operator, ``()``, ``[]``, ``{}``, ``<>``, ``""``."""
        t, out, k = self.t, [], 0
        while k < len(head):
            i = head[k]
            text = t.text[i]
            if t.kind[i] == OP and text in "([{" and t.partner.get(i, -1) > i:
                close = t.partner[i]
                out.append((text + t.text[close], i))
                while k < len(head) and head[k] <= close:
                    k += 1
                continue
            if text == "<" and out and (t.kind[head[k - 1]] == ID or out[-1][0] == "template") and (end := self.arguments(head, k)):
                out.append(("<>", i))
                k = end + 1
                continue
            out.append(('""' if t.kind[i] == STRING else "0" if t.kind[i] == NUMBER else text, i))
            k += 1
        return out

    def arguments(self, head: list[int], k: int) -> int:
        """The place in head of the ``>`` that closes type arguments opened at k; 0 where it is a comparison."""
        depth, t = 0, self.t
        j, last = k, min(len(head), k + ARGUMENTS)
        while j < last:
            text = t.text[head[j]]
            if text == "<":
                depth += 1
            elif text == ">":
                depth -= 1
                if not depth:
                    return j
            elif text in ("&&", "||", ";", "==", "!=", "+", "/", "%", "!") or (text == "{" and self.language != "typescript"):
                return 0
            j += 1
        return 0

    def is_id(self, item: tuple[str, int]) -> bool:
        return self.t.kind[item[1]] == ID and item[0] not in ("()", "[]", "{}", "<>")

    def declare(self, name: int, kind: str, scope: str, head: list[int], end: int, signature: int | None = None, definition: bool = True) -> str:
        t = self.t
        self.taken.add(name)
        lo = t.start[head[0]] if head else t.start[name]
        tilde = self.language == "cpp" and name and t.text[name - 1] == "~"  # a destructor's name
        written = None
        if signature is not None:
            written = re.sub(r"\s+", " ", self.text[t.start[signature] : t.end[t.partner[signature]]])
        qualified = self.facts.symbol("~" * tilde + t.text[name], kind, scope, self.byte(t.start[name - tilde]), self.byte(t.end[name]), (self.byte(lo), self.byte(end)), written, definition=definition, delimiter=self.delimiter)
        self.owner.setdefault(qualified, kind)
        return qualified

    # blocks
    def opened(self, head: list[int], brace: int, ctx: Context) -> Context:
        """Declares what a block belongs to, and says what it is."""
        t = self.t
        if ctx.depth:  # inside brackets, what counts is what follows the last of them
            head = head[max((k + 1 for k, i in enumerate(head) if t.kind[i] == OP and t.text[i] in "([" and t.partner.get(i, brace) > brace), default=0) :]
        flat = self.flat(head)
        close = t.partner.get(brace, len(t) - 1)
        end = t.end[close]
        words = [x for x, _ in flat]
        outer = ctx.scope
        if ctx.kind == "enum" and self.language == "java" and head:
            self.member(head, ctx)
            return Context("type", outer)
        if found := self.type_of(flat):
            word, name, rest = found
            if word == "namespace" and name is None:
                return Context("namespace", outer)
            if name is None:
                return Context("enum" if word == "enum" else "type", outer, word=word)
            scope, last = self.path_to(flat, name, outer)
            kind = KINDS.get(word, word)
            qualified = self.declare(flat[last][1], kind, scope, head, end)
            self.bases(flat[rest:], qualified)
            self.spans.append((t.start[brace], end, qualified))
            return Context({"enum": "enum", "namespace": "namespace"}.get(kind, "type"), qualified, word=word)
        if found := self.function_of(flat, ctx):
            name, group, scope, kind = found
            qualified = self.declare(name, kind, scope, head, end, group)
            self.spans.append((t.start[brace], end, qualified))
            if self.language == "cpp" and ":" in words:  # members that a constructor sets up
                self.taken.update(flat[k][1] for k in range(words.index(":"), len(flat) - 1) if words[k + 1] in ("()", "{}"))
            return Context("function", qualified)
        if self.language == "go" and words[:1] == ["type"] and len(flat) > 2 and words[-1] in ("struct", "interface"):
            qualified = self.declare(flat[1][1], words[-1], outer, head, end)
            self.spans.append((t.start[brace], end, qualified))
            return Context("type", qualified, word=words[-1])
        if self.language == "csharp" and ctx.kind == "type" and "()" not in words and "=" not in words and "=>" not in words and len(flat) > 1 and self.is_id(flat[-1]):
            self.declare(flat[-1][1], "field", outer, head, end)
            return Context("block", outer)
        if words[-1:] == ["()"] and "new" in words and self.language in ("java", "csharp"):
            return Context("type", outer)
        if not words or words[-1] in ("()", "=>", "else", "do", "try", "finally", "static", "unsafe", "checked", "get", "set", "->", ">") or words[0] in self.control or "function" in words:
            return Context("init" if not words and ctx.depth else "block", outer, on="=" in words and not self.lines)
        return Context("init", outer)

    def type_of(self, flat: list) -> tuple[str, int | None, int] | None:
        """(word, place of the name or none, place after it) where a block is a type's or a namespace's."""
        for k, (text, _) in enumerate(flat):
            if text in ("=", "()", "=>", "return", "new") and not (text == "()" and k and flat[k - 1][0] in ("alignas", "__attribute__", "__declspec")):
                return None
            if text in TYPE_WORDS[self.language] and self.is_id(flat[k]) and not (k and flat[k - 1][0] in (".", "::", "->")):
                j = k + 1
                while j < len(flat) and (flat[j][0] in ("class", "struct", "[]", "()", "alignas") or (flat[j][0] == "const" and text == "enum")):
                    j += 1
                if j >= len(flat) or not self.is_id(flat[j]) or flat[j][0] in ("extends", "implements"):
                    return (text, None, j)
                while j + 2 < len(flat) and flat[j + 1][0] in ("::", ".") and self.is_id(flat[j + 2]):
                    j += 2
                rest = j + 1
                if self.language in ("c", "cpp") and any(x == "()" for x, _ in flat[rest : next((n for n in range(rest, len(flat)) if flat[n][0] == ":"), len(flat))]):
                    return None  # a function that gives a struct
                return (text, j, rest)
        return None

    def path_to(self, flat: list, name: int, outer: str) -> tuple[str, int]:
        """The scope of a name written as ``A::B::name`` or ``A.B``, and the place of its last part."""
        parts, k = [], name - (name > 0 and flat[name - 1][0] == "~")
        while k >= 2 and flat[k - 1][0] in ("::", "."):
            k -= 2
            if flat[k][0] == "<>" and k:
                k -= 1
            if not self.is_id(flat[k]):
                break
            parts.append(flat[k][0])
        return self.delimiter.join(x for x in (outer, *reversed(parts)) if x), name

    def bases(self, rest: list, qualified: str) -> None:
        kind, expects, k = "inheritance", False, 0
        while k < len(rest):
            text, _ = rest[k]
            if text == "where":
                return
            if text in ("extends", "implements", ":"):
                kind, expects = "implementation" if text == "implements" else "inheritance", True
            elif text == ",":
                expects = True
            elif text in ("public", "private", "protected", "virtual"):
                pass
            elif expects and self.is_id(rest[k]):
                first = k
                while k + 2 < len(rest) and rest[k + 1][0] in (".", "::"):
                    k += 2
                lo, hi = rest[first][1], rest[k][1]
                name = "".join(x for x, _ in rest[first : k + 1])
                implements = kind == "implementation" or (self.language == "csharp" and re.match("I[A-Z]", name))
                self.facts.occurrence(name, "implementation" if implements else "inheritance", qualified, self.byte(self.t.start[lo]), self.byte(self.t.end[hi]), SEEN, metadata=json.dumps({"enclosingScope": qualified}))
                expects = False
            k += 1

    def function_of(self, flat: list, ctx: Context) -> tuple[int, int, str, str] | None:
        """(name, parameters, scope, kind) where a block is a function's body, or a statement its declaration."""
        words, outer = [x for x, _ in flat], ctx.scope
        in_type = ctx.kind in ("type", "enum")
        if self.language == "go":
            if words[:1] != ["func"]:
                return None
            k = 1
            if len(flat) > 2 and words[1] == "()":
                inside = [i for i in range(flat[1][1] + 1, self.t.partner[flat[1][1]]) if self.t.kind[i] == ID]
                opened = [i for i in inside if "[" in self.t.text[flat[1][1] + 1 : i]]
                named = [i for i in inside if i not in opened]
                if not named:
                    return None
                receiver = self.t.text[named[-1]]
                outer, k = self.delimiter.join(x for x in (outer, receiver) if x), 2
            group = next((n for n in range(k, len(flat)) if words[n] == "()"), None)
            if group is None or not self.is_id(flat[k]) or words[k] == "func":
                return None
            return flat[k][1], flat[group][1], outer, "method" if k == 2 else "function"
        if self.language in ("javascript", "typescript"):
            return self.script_function(flat, words, ctx)
        if ctx.kind in ("function", "block") and self.language != "csharp":
            return None
        for k, (text, i) in enumerate(flat):
            if text in ("=", "=>", "new", "return") and not (text == "=" and k and words[k - 1] == "operator"):
                return None
            if text == "()" and k:
                j = k - 1
                if words[j] == "<>" and j:
                    j -= 1
                if "operator" in words[:k]:
                    j = words.index("operator")
                if not self.is_id(flat[j]) or words[j] in self.control or words[j] in ("alignas", "__attribute__", "__declspec", "decltype", "noexcept", "explicit"):
                    if words[j] in self.control:
                        return None
                    continue
                scope, _ = self.path_to(flat, j, outer)
                own = scope != outer or in_type or self.owner.get(outer) in ("class", "struct", "interface")
                before = [x for x in words[: j - 2 * (scope != outer)] if x not in ("~",)]
                if not before and not in_type and scope == outer and not (self.language in ("c", "cpp") and ctx.kind in ("file", "namespace")):
                    return None
                if ctx.kind in ("function", "block") and not before:
                    return None
                return flat[j][1], i, scope, "method" if own else "function"
        return None

    def script_function(self, flat: list, words: list[str], ctx: Context) -> tuple[int, int, str, str] | None:
        outer, in_type = ctx.scope, ctx.kind == "type"
        group = next((n for n, x in enumerate(words) if x == "()"), None)
        if "function" in words:
            f = words.index("function")
            group = next((n for n in range(f, len(words)) if words[n] == "()"), None)
            k = f + 1 + (words[f + 1 : f + 2] == ["*"])
            if group is not None and k < group and self.is_id(flat[k]):
                return flat[k][1], flat[group][1], outer, "function"
            return self.bound(flat, words, f, group, ctx)
        if words[-1:] == ["=>"] or "=>" in words:
            arrow = words.index("=>")
            return self.bound(flat, words, arrow, group if group is not None and group < arrow else None, ctx)
        if group and (in_type or ctx.kind == "init") and "=" not in words[:group]:
            j = group - 1 - (words[group - 1] == "<>")
            if j >= 0 and self.is_id(flat[j]) and words[j] not in self.control and (not j or words[j - 1] in MODIFIERS or words[j - 1] in ("get", "set", "*", "#", ",") or words[j - 1] == "()"):
                return flat[j][1], flat[group][1], outer, "method" if in_type else "function"
        return None

    def bound(self, flat: list, words: list[str], at: int, group: int | None, ctx: Context) -> tuple[int, int, str, str] | None:
        """A function without a name of its own that is given to one: ``const f = ``, ``a.b.f = ``, a field."""
        if "=" not in words[:at]:
            return None
        eq = words.index("=")
        if any(x == "()" for x in words[:eq]) or any(x == "()" for n, x in enumerate(words[eq + 1 : at], eq + 1) if n != group):
            return None  # an argument of a call
        stop = words.index(":") if ":" in words[:eq] else eq
        k = stop - 1
        if k < 0 or not self.is_id(flat[k]):
            return None
        scope = ctx.scope
        if k >= 2 and words[k - 1] == ".":
            owner = [x for x in words[:k:2] if x != "prototype"]
            scope = self.delimiter.join(x for x in (scope, *owner) if x and x != "module" and x != "exports")
            kind = "method" if "prototype" in words else "function"
        else:
            kind = "method" if ctx.kind == "type" else "function"
        return flat[k][1], flat[group][1] if group is not None else None, scope, kind

    # statements
    def statement(self, head: list[int], ctx: Context) -> None:
        t = self.t
        if ctx.kind == "enum" and self.language != "java":
            return self.member(head, ctx)
        flat = self.flat(head)
        words = [x for x, _ in flat]
        while len(flat) > 1 and words[0] in ("template", "<>", "@", "[]") or (len(flat) > 2 and words[0] == "@"):
            drop = 2 if words[0] == "@" else 1
            flat, words = flat[drop:], words[drop:]
            if words[:1] == ["()"] and drop == 2:
                flat, words = flat[1:], words[1:]
        if not flat:
            return None
        end = t.end[head[-1]]
        first = words[0]
        if self.language == "go":
            return self.go_statement(flat, words, head, ctx, end)
        if self.language in ("javascript", "typescript"):
            return self.script_statement(flat, words, head, ctx, end)
        if first == "typedef":
            name = next((flat[k][1] for k in range(len(flat) - 1, 0, -1) if self.is_id(flat[k])), None)
            pointer = next((i for x, i in flat if x == "()"), None)
            if pointer is not None and t.text[pointer + 1] == "*" and t.kind[pointer + 2] == ID:
                name = pointer + 2
            if name is not None:
                self.declare(name, "type_alias", ctx.scope, head, end)
            return None
        if first == "package":
            return self.package(flat, head, end)
        if first in ("using", "namespace") and self.language == "cpp":
            if len(flat) > 2 and words[2] == "=":
                self.declare(flat[1][1], "namespace" if first == "namespace" else "type_alias", ctx.scope, head, end)
            return None
        if first in ("using", "import", "friend", "goto") or first in self.control:
            return None
        pointer = next((i for n, (x, i) in enumerate(flat[:-1]) if n and "=" not in words[:n] and x == "()" == words[n + 1] and t.text[i + 1] == "*" and t.kind[i + 2] == ID), None)
        if self.language in ("c", "cpp") and pointer is not None:
            self.declare(pointer + 2, "field" if ctx.kind == "type" else "variable", ctx.scope, head, end)
            return None
        if ctx.kind in ("file", "namespace", "type") and (found := self.function_of(flat, ctx)):
            name, group, scope, kind = found
            before = [x for x in words[: next(n for n, (_, i) in enumerate(flat) if i == name)] if x not in ("~",)]
            if before or ctx.kind == "type":
                self.declare(name, kind, scope, head, end, group, definition="=>" in words)
            return None
        if len(flat) == 2 and first in TYPE_WORDS[self.language] and self.is_id(flat[1]):
            self.declare(flat[1][1], KINDS.get(first, first), ctx.scope, head, end, definition=False)
            return None
        if self.language == "csharp" and ctx.kind in ("function", "block"):
            return None  # what is local there is no symbol
        return self.variables(flat, words, head, ctx, end)

    def variables(self, flat: list, words: list[str], head: list[int], ctx: Context, end: int) -> None:
        """``type name [= value] [, name ...]``."""
        kind = "field" if ctx.kind in ("type", "enum") else "variable"
        definition = "extern" not in words
        lo, typed = 0, False
        for k in range(len(flat) + 1):
            if k < len(flat) and words[k] != ",":
                continue
            piece = flat[lo:k]
            stop = next((n for n, (x, _) in enumerate(piece) if x in ("=", "[]", ":", "=>") or (x == "{}" and n > 1 and self.is_id(piece[n - 1]) and not (n == 2 and piece[0][0] in ("struct", "class", "union", "enum"))) or (x == "()" and n)), len(piece))
            if stop < len(piece) and piece[stop][0] == "[]" and self.language in ("java", "csharp") and stop + 1 < len(piece) and self.is_id(piece[stop + 1]):
                stop = next((n for n in range(stop + 1, len(piece)) if piece[n][0] in ("=", "=>", ":")), len(piece))
            if not stop:
                return
            name = piece[stop - 1]
            if not self.is_id(name) or name[0] in MODIFIERS:
                return
            if not typed:
                before = [x for x, _ in piece[: stop - 1]]
                core = [x for x in before if x not in MODIFIERS]
                good = core and (self.is_id(piece[len(before) - 1]) or core[-1] in ("<>", "[]", "*", "&", "&&", "?", "{}")) and core[-1] not in self.control
                if not good or not self.is_id(piece[0]) or any(x not in ("*", "&", "&&", "::", ".", "?", "<>", "[]", "{}", "()") and not x[0].isalpha() and x[0] not in "_$" for x in core):
                    return
                typed = True
            elif [x for x, _ in piece[: stop - 1] if x not in ("*", "&")]:
                return
            self.declare(name[1], kind, ctx.scope, head, end, definition=definition)
            lo = k + 1

    def package(self, flat: list, head: list[int], end: int) -> None:
        if len(flat) > 1:
            name = "".join(x for x, _ in flat[1:])
            t = self.t
            self.facts.symbol(name, "package", "", self.byte(t.start[flat[1][1]]), self.byte(t.end[flat[-1][1]]), (self.byte(t.start[head[0]]), self.byte(end)), delimiter=self.delimiter)

    def member(self, head: list[int], ctx: Context) -> None:
        flat = [x for x in self.flat(head) if x[0] not in ("[]",)]
        while len(flat) > 1 and flat[0][0] == "@":
            flat = flat[2:]
        if flat and self.is_id(flat[0]):
            self.declare(flat[0][1], "enum_member", ctx.scope, head, self.t.end[head[-1]])

    def go_statement(self, flat, words, head, ctx, end) -> None:
        word = ctx.word if ctx.kind == "group" else words[0]
        rest = flat if ctx.kind == "group" else flat[1:]
        if words[0] == "package":
            return self.package(flat, head, end)
        if ctx.kind == "type":
            if len(flat) > 1 and words[1] == "()":
                self.declare(flat[0][1], "method", ctx.scope, head, end, flat[1][1], definition=False)
            elif [x for x in words if x not in ("*", ".", '""')] and len([x for x in words if x not in ('""', "*")]) == (3 if "." in words else 1):
                lo, hi = flat[words[0] == "*"][1], next(i for x, i in reversed(flat) if x != '""')
                self.facts.occurrence("".join(x for x in words if x not in ("*", '""')), "inheritance", ctx.scope, self.byte(self.t.start[lo]), self.byte(self.t.end[hi]), SEEN, metadata=json.dumps({"enclosingScope": ctx.scope}))
            else:
                for k in range(0, len(flat), 2):
                    if not self.is_id(flat[k]):
                        break
                    self.declare(flat[k][1], "field", ctx.scope, head, end)
                    if k + 1 >= len(flat) or words[k + 1] != ",":
                        break
            return None
        if word == "type" and rest and self.is_id(rest[0]):
            self.declare(rest[0][1], "type_alias", ctx.scope, head, end)
        elif word in ("var", "const") or ":=" in words:
            names = rest if word in ("var", "const") else flat[1:] if words[0] in ("for", "if", "switch") else flat
            for k in range(0, len(names), 2):
                if not self.is_id(names[k]):
                    break
                if names[k][0] != "_":
                    self.declare(names[k][1], "variable", ctx.scope, head, end)
                if k + 1 >= len(names) or names[k + 1][0] != ",":
                    break
        return None

    def script_statement(self, flat, words, head, ctx, end) -> None:
        if words[0] in ("import", "export"):
            self.renamed(flat, words, head, ctx, end)
        while words and words[0] in ("export", "default", "declare", "async"):
            flat, words = flat[1:], words[1:]
        if not flat or words[0] in self.control or words[0] in ("import", "return"):
            return None
        if words[0] == "type" and len(flat) > 2 and self.is_id(flat[1]) and "=" in words:
            self.declare(flat[1][1], "type_alias", ctx.scope, head, end)
        elif found := self.function_of(flat, ctx):
            name, group, scope, kind = found
            self.declare(name, kind, scope, head, end, group, definition="=>" in words)
        elif words[0] in ("const", "let", "var"):
            if ctx.kind in ("file", "namespace"):  # what is local to a function is no symbol
                self.bindings(flat[1:], ctx, head, end)
        elif ctx.kind == "type":
            k = next((n for n, x in enumerate(words) if x not in MODIFIERS and x not in ("#", "get", "set")), None)
            if k is not None and self.is_id(flat[k]) and (k + 1 == len(words) or words[k + 1] in ("=", ":", "?", "!")):
                call = k + 1 < len(words) and words[k + 1] == "()"
                self.declare(flat[k][1], "method" if call else "field" if ctx.word == "interface" else "variable", ctx.scope, head, end)
        elif "prototype" in words and "=" in words and (eq := words.index("=")) == 5 and self.is_id(flat[4]):
            self.declare(flat[4][1], "field", self.delimiter.join(x for x in (ctx.scope, words[0]) if x), head, end)
        return None

    def renamed(self, flat, words, head, ctx, end) -> None:
        """Names that an import binds, and new names in braces: ``d``, ``* as ns``, ``{ a as b }``."""
        t = self.t
        for k, (text, i) in enumerate(flat[1:], 1):
            if text in ("from", "=") or text == '""':
                return
            if text == "{}":
                for j in range(i + 1, t.partner[i]):
                    if t.kind[j] == ID and t.text[j - 1] == "as" and t.text[j] != "default":
                        self.declare(j, "type_alias", "", head, end)
                if words[0] == "export":
                    return
            elif words[0] == "import" and self.is_id(flat[k]) and text not in ("type", "as"):
                self.declare(i, "namespace" if words[k - 1] == "as" else "variable", "", head, end)

    def bindings(self, flat, ctx, head, end) -> None:
        t, expects = self.t, True
        for k, (text, i) in enumerate(flat):
            if expects and text in ("{}", "[]"):
                for j in range(i + 1, t.partner[i]):
                    if t.kind[j] == ID and t.text[j + 1] in (",", "}", "]", "=", "\n") and t.text[j - 1] in (",", "{", "[", ":", "...", "\n"):
                        self.declare(j, "variable", ctx.scope, head, end)
                expects = False
            elif expects and self.is_id(flat[k]):
                if i not in self.taken:
                    self.declare(i, "variable", ctx.scope, head, end)
                expects = False
            elif text == ",":
                expects = True

    def ends(self, head: list[int], i: int, ctx: Context) -> bool:
        """Whether the line end at i ends a statement."""
        t = self.t
        if not head or ctx.depth:
            return False
        last = head[-1]
        if t.kind[last] == OP and t.text[last] not in (")", "]", "}", "++", "--", ">"):
            return False
        if self.language == "go":
            return True
        j = i + 1
        while j < len(t) and t.kind[j] == LINE:
            j += 1
        if t.kind[last] == ID and t.text[last] in ("extends", "implements", "return", "const", "export", "default", "async", "new"):
            return False
        return j >= len(t) or t.kind[j] != OP or t.text[j] in ("}", "@", "#", "++", "--") or (t.text[j] in "{[(*" and ctx.kind == "type")

    def run(self) -> Facts:
        t = self.t
        stack = [Context("file", "")]
        head: list[int] = []
        for i in range(len(t)):
            ctx, kind, text = stack[-1], t.kind[i], t.text[i]
            if kind == DIRECTIVE:
                self.directive(i, ctx)
            elif kind == LINE:
                if self.lines and ctx.kind != "init" and self.ends(head, i, ctx):
                    self.statement(head, ctx)
                    if self.language == "go" and t.text[head[0]] == "package":
                        ctx.scope = t.text[head[-1]]
                    head = []
            elif kind != OP or text not in "([{}]);,:":
                head.append(i)
            elif text == "(" and self.language == "go" and len(head) == 1 and t.text[head[0]] in ("import", "var", "const", "type") and not ctx.depth:
                stack.append(Context("group", ctx.scope, [], 0, t.text[head[0]]))
                head = []
            elif text in "([":
                head.append(i)
                ctx.depth += 1
            elif text in ")]":
                if ctx.kind == "group" and text == ")" and not ctx.depth:
                    if head:
                        self.statement(head, ctx)
                    stack.pop()
                    head = []
                    continue
                head.append(i)
                ctx.depth = max(ctx.depth - 1, 0)
            elif text == "{":
                inner = self.opened(head, i, ctx)
                inner.head = [*head, i]
                stack.append(inner)
                head = []
            elif text == "}":
                if head:
                    self.statement(head, ctx)
                head = []
                if len(stack) > 1:
                    done, ctx = stack.pop(), stack[-1]
                    goes_on = done.kind == "init" or done.on or ctx.depth or (done.kind in ("type", "enum") and self.language in ("c", "cpp"))
                    head = [*done.head, i] if goes_on else []
                    if done.kind == "function" and not ctx.depth and self.lines and "=" in (t.text[j] for j in done.head[:8]):
                        head = []
            elif text == ";":
                if ctx.depth:
                    head.append(i)
                    continue
                if ctx.kind == "enum" and self.language == "java":
                    if head:
                        self.member(head, ctx)
                    ctx.kind = "type"
                elif head:
                    self.declared_after(head, ctx)
                if self.language == "csharp" and head and t.text[head[0]] == "namespace":
                    flat = self.flat(head)
                    ctx.scope = "".join(x for x, _ in flat[1:])
                if self.language == "java" and head and t.text[head[0]] == "package":
                    ctx.scope = ""
                head = []
            elif text == "," and ctx.kind == "enum" and not ctx.depth:
                if head:
                    self.member(head, ctx)
                head = []
            elif text == ":" and self.language == "cpp" and len(head) == 1 and t.text[head[0]] in ("public", "private", "protected"):
                head = []
            else:
                head.append(i)
        if head:
            self.statement(head, stack[-1])
        self.uses()
        if t.unbalanced:
            self.facts.diagnostic("error", "syntax.missing", "unbalanced braces" if t.unbalanced > 0 else "brace closed that wasn't opened", len(self.facts.starts) - 1)
        return self.facts

    def declared_after(self, head: list[int], ctx: Context) -> None:
        """A statement that a semicolon ends; one that ends a C type may name variables, or an alias, after its body."""
        t = self.t
        if self.language in ("c", "cpp") and t.text[head[0]] != "typedef":
            body = next((k for k, i in enumerate(head) if t.text[i] == "{" and t.partner.get(i, -1) > i), None)
            if body is not None and any(t.text[i] in TYPE_WORDS[self.language] for i in head[:body]) and "=" not in [t.text[i] for i in head[:body]]:
                close = t.partner[head[body]]
                after = [i for i in head[body:] if i > close]
                for i in after:
                    if t.kind[i] == ID:
                        self.declare(i, "field" if ctx.kind == "type" else "variable", ctx.scope, head, t.end[head[-1]])
                return
        self.statement(head, ctx)

    # uses
    def directive(self, i: int, ctx: Context) -> None:
        m = re.match(r"[ \t]*#[ \t]*(include|import|define)[ \t]*([<\"][^>\"\n]+[>\"]|\w+)", self.t.text[i])
        if not m or (m[1] == "define") != (m[2][0] not in "<\""):
            return
        lo, hi = self.t.start[i] + m.start(2), self.t.start[i] + m.end(2)
        if m[1] == "define":
            self.facts.symbol(m[2], "macro", "", self.byte(lo), self.byte(hi), delimiter=self.delimiter)
        else:
            self.facts.occurrence(m[2].strip('"'), "include", ctx.scope, self.byte(lo), self.byte(hi), SEEN)

    def scopes(self):
        """The innermost scope at each place, for places in rising order."""
        spans, open_, k = sorted(self.spans), [], 0

        def at(place: int) -> str:
            nonlocal k
            while k < len(spans) and spans[k][0] <= place:
                open_.append(spans[k])
                k += 1
            while open_ and open_[-1][1] <= place:
                open_.pop()
            return open_[-1][2] if open_ else ""

        return at

    def uses(self) -> None:
        t, scope_at, real = self.t, self.scopes(), [i for i in range(len(self.t)) if self.t.kind[i] not in (LINE, DIRECTIVE)]
        note = self.facts.occurrence
        for k, i in enumerate(real):
            if t.kind[i] == STRING:
                if target := self.imported(real, k):
                    dynamic = t.text[i][0] == "`" and "${" in t.text[i]
                    note(target, "import", scope_at(t.start[i]), self.byte(t.start[i]), self.byte(t.end[i]), 0.0 if dynamic else SEEN, metadata=json.dumps({"dynamic": True}) if dynamic else None)
                continue
            if t.kind[i] != ID or t.text[i] in NOT_CALLS or t.text[i] in self.control or i in self.taken:
                continue
            before = t.text[real[k - 1]] if k else ""
            n = k + 1
            if n < len(real) and t.text[real[n]] == "<" and self.language in ("csharp", "java", "typescript", "cpp"):
                end = self.arguments(real[n : n + ARGUMENTS], 0)
                n = n + end + 1 if end else n
            if n < len(real) and t.text[real[n]] == "(" and real[n] in t.partner:
                receiver = t.text[real[k - 2]] if k > 1 and before in (".", "->", "::", "?.") and t.kind[real[k - 2]] == ID else None
                note(t.text[i], "call", scope_at(t.start[i]), self.byte(t.start[i]), self.byte(t.end[i]), ON_RECEIVER if receiver else SEEN, self.arity(real[n]), receiver)
            elif before == "<" and t.text[i][:1].isupper() and self.path.endswith(("x", "js")) and k > 1 and (t.kind[real[k - 2]] != ID or t.text[real[k - 2]] in self.control):
                last = k
                while last + 2 < len(real) and t.text[real[last + 1]] == "." and t.kind[real[last + 2]] == ID:
                    last += 2
                note("".join(t.text[x] for x in real[k : last + 1]), "call", scope_at(t.start[i]), self.byte(t.start[i]), self.byte(t.end[real[last]]), SEEN)
            elif before == "new" or (before == "::" and self.language == "java"):
                note(t.text[i], "call" if before == "new" else "reference", scope_at(t.start[i]), self.byte(t.start[i]), self.byte(t.end[i]), SEEN)
        for m in re.finditer(_IMPORTS[self.language], self.text, re.MULTILINE) if self.language in _IMPORTS else ():
            note(m["name"], "import", "", self.byte(m.start("name")), self.byte(m.end("name")), SEEN, metadata=json.dumps(said) if (said := _import_options(m)) else None)

    def imported(self, real: list[int], k: int) -> str | None:
        """The module that a string names, where it stands in an import."""
        t = self.t
        before = t.text[real[k - 1]] if k else ""
        bare = t.text[real[k]].strip("\"'`")
        if self.language == "go":
            j = k - 1 - (k > 0 and (t.kind[real[k - 1]] == ID and t.text[real[k - 1]] != "import" or t.text[real[k - 1]] == "."))
            while j >= 0 and t.kind[real[j]] == STRING:
                j -= 1 + (j > 0 and t.kind[real[j - 1]] == ID and t.text[real[j - 1]] != "import")
            inside = j >= 0 and (t.text[real[j]] == "import" or (t.text[real[j]] == "(" and j and t.text[real[j - 1]] == "import"))
            return bare if inside else None
        if self.language not in ("javascript", "typescript"):
            return None
        if before in ("from", "import") or (before == "(" and k > 1 and t.text[real[k - 2]] in ("require", "import")):
            return bare
        return None

    def arity(self, at: int) -> int | None:
        t, commas, some, i = self.t, 0, False, at + 1
        close = t.partner[at]
        while i < close:
            if t.kind[i] not in (LINE, DIRECTIVE):
                some = True
            commas += t.text[i] == ","
            i = t.partner[i] + 1 if t.partner.get(i, -1) > i else i + 1
        return commas + 1 if some else 0


def extractor(language: str):
    """The extractor (text, path) to facts of one language."""
    if language in ("shell", "bash"):
        from quarrylight.extract import shell

        return shell.extract
    return lambda text, path: Scan(text, path, language).run()


LANGUAGES = [*TYPE_WORDS, "shell", "bash"]
