"""Python facts from the standard library's syntax tree."""

from __future__ import annotations

import ast
import json
import re

from quarrylight.extract.facts import Facts

#: Confidence of a call by its receiver: a plain name, self or cls, anything else.
PLAIN, OWN, OTHER = 1.0, 0.9, 0.5


def extract(text: str, path: str) -> Facts:
    facts = Facts(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        line = max((getattr(e, "lineno", None) or 1) - 1, 0)
        facts.diagnostic("error", "syntax.error", str(getattr(e, "msg", e)), line, max((getattr(e, "offset", None) or 1) - 1, 0))
        return facts
    module = re.sub(r"(/__init__)?\.pyw?i?$", "", path).replace("/", ".")
    facts.symbol(module.rpartition(".")[2], "module", "", 0, len(facts.raw), documentation=ast.get_docstring(tree))
    _Visitor(facts).body(tree.body, "", None)
    return facts


class _Visitor:
    def __init__(self, facts: Facts):
        self.f = facts

    def at(self, node) -> tuple[int, int]:
        return self.f.offset(node.lineno - 1, node.col_offset), self.f.offset(node.end_lineno - 1, node.end_col_offset)

    def name_in(self, node, name: str, lo: int) -> tuple[int, int]:
        """Where a definition's name stands: the first such word from lo on."""
        found = re.compile(rb"(?<![\w])" + re.escape(name.encode()) + rb"(?![\w])").search(self.f.raw, lo)
        return found.span() if found else self.at(node)

    def body(self, nodes, scope: str, owner: str | None) -> None:
        for node in nodes:
            self.visit(node, scope, owner)

    def visit(self, node, scope: str, owner: str | None) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(node, scope, owner)
        elif isinstance(node, ast.ClassDef):
            self.klass(node, scope)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            self.imports(node, scope)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                for n in ast.walk(t):
                    if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                        if owner == "function":  # a local name is a use, not a symbol
                            self.f.occurrence(n.id, "reference", scope, *self.at(n))
                        else:
                            self.f.symbol(n.id, "variable", scope, *self.at(n), body=self.at(node))
            self.expressions([c for c in (getattr(node, "value", None), getattr(node, "annotation", None)) if c], scope)
        else:
            children = list(ast.iter_child_nodes(node))
            self.expressions([c for c in children if isinstance(c, ast.expr)], scope)
            for c in children:
                if isinstance(c, (ast.stmt, ast.excepthandler, ast.match_case)):
                    self.visit(c, scope, owner)
                elif isinstance(c, ast.withitem):
                    self.expressions([x for x in (c.context_expr, c.optional_vars) if x], scope)

    def function(self, node, scope: str, owner: str | None) -> None:
        lo, hi = self.at(node)
        name = self.name_in(node, node.name, self.f.offset(node.lineno - 1, node.col_offset))
        signature = f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        self.decorators(node, scope)
        qualified = self.f.symbol(node.name, "method" if owner == "class" else "function", scope, *name, body=(lo, hi), signature=signature, documentation=ast.get_docstring(node))
        a = node.args
        self.expressions([x for x in [*a.defaults, *a.kw_defaults, *(p.annotation for p in [*a.posonlyargs, *a.args, *a.kwonlyargs]), node.returns] if x], scope)
        self.body(node.body, qualified, "function")

    def klass(self, node, scope: str) -> None:
        self.decorators(node, scope)
        name = self.name_in(node, node.name, self.f.offset(node.lineno - 1, node.col_offset))
        qualified = self.f.symbol(node.name, "class", scope, *name, body=self.at(node), documentation=ast.get_docstring(node))
        for base in node.bases:
            written = _dotted(base)
            if written:
                self.f.occurrence(written, "inheritance", qualified, *self.at(base), metadata=json.dumps({"enclosingScope": qualified}))
        self.expressions([*node.bases, *(k.value for k in node.keywords)], scope)
        self.body(node.body, qualified, "class")

    def decorators(self, node, scope: str) -> None:
        for d in node.decorator_list:
            target = d.func if isinstance(d, ast.Call) else d
            if written := _dotted(target):
                self.f.occurrence(written, "call", scope, *self.at(target), metadata=json.dumps({"is_decorator": True}))

    def imports(self, node, scope: str) -> None:
        prefix = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "")
        for alias in node.names:
            whole = alias.name if isinstance(node, ast.Import) else f"{prefix}.{alias.name}" if prefix.strip(".") else f"{prefix}{alias.name}"
            self.f.occurrence(alias.name, "import", scope, *self.at(alias), metadata=json.dumps({"module": alias.name if isinstance(node, ast.Import) else prefix, "path": whole}))
            if alias.asname:
                end = self.at(alias)[1]
                self.f.symbol(alias.asname, "type_alias", scope, end - len(alias.asname.encode()), end)

    def expressions(self, nodes, scope: str) -> None:
        stack = list(reversed(nodes))
        while stack:
            n = stack.pop()
            if isinstance(n, ast.Call):
                self.call(n, scope)
                stack += [*reversed(n.args), *(k.value for k in n.keywords)]
                if isinstance(n.func, ast.Attribute):
                    stack.append(n.func.value)
                elif not isinstance(n.func, ast.Name):
                    stack.append(n.func)
                continue
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                self.f.occurrence(n.id, "reference", scope, *self.at(n))
            stack += [c for c in reversed(list(ast.iter_child_nodes(n))) if isinstance(c, (ast.expr, ast.comprehension, ast.keyword, ast.FormattedValue))]

    def call(self, n: ast.Call, scope: str) -> None:
        arity = len(n.args) + len(n.keywords)
        if isinstance(n.func, ast.Name):
            self.f.occurrence(n.func.id, "call", scope, *self.at(n.func), confidence=PLAIN, arity=arity)
        elif isinstance(n.func, ast.Attribute):
            receiver = _dotted(n.func.value)
            end = self.at(n.func)[1]
            written = f"{receiver}.{n.func.attr}" if receiver and receiver not in ("self", "cls") else n.func.attr
            self.f.occurrence(written, "call", scope, end - len(n.func.attr.encode()), end, confidence=OWN if receiver in ("self", "cls") else OTHER, arity=arity, receiver=receiver)


def _dotted(node) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None
