"""What an extractor says about one file."""

from __future__ import annotations

from bisect import bisect_right


class Facts:
    """Collects symbols, occurrences and diagnostics; positions are given as byte offsets."""

    def __init__(self, text: str):
        self.raw = text.encode()
        self.starts = [0]
        for i, b in enumerate(self.raw):
            if b == 10:
                self.starts.append(i + 1)
        self.symbols: list[dict] = []
        self.occurrences: list[dict] = []
        self.diagnostics: list[dict] = []

    def offset(self, line: int, column: int) -> int:
        """Byte offset of a zero-based line and byte column."""
        return self.starts[min(line, len(self.starts) - 1)] + column

    def place(self, start: int, end: int) -> dict:
        a, b = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end) - 1
        return {"start_byte": start, "end_byte": end, "start_line": a, "start_column": start - self.starts[a], "end_line": b, "end_column": end - self.starts[b]}

    def symbol(self, name: str, kind: str, scope: str, start: int, end: int, body: tuple[int, int] | None = None, signature: str | None = None, documentation: str | None = None, definition: bool = True, delimiter: str = ".") -> str:
        """Adds a symbol and returns its qualified name; the range is that of its name."""
        qualified = f"{scope}{delimiter}{name}" if scope else name
        lo, hi = body or (start, end)
        self.symbols.append({"name": name, "qualified_name": qualified, "kind": kind, "scope": scope, "signature": signature, "documentation": documentation, "is_definition": definition, "body_start": lo, "body_end": hi} | self.place(start, end))
        return qualified

    def occurrence(self, name: str, kind: str, scope: str, start: int, end: int, confidence: float = 1.0, arity: int | None = None, receiver: str | None = None, metadata: str | None = None) -> None:
        self.occurrences.append({"name": name, "kind": kind, "scope": scope, "arity": arity, "receiver": receiver, "confidence": confidence, "metadata": metadata} | self.place(start, end))

    def diagnostic(self, severity: str, code: str, message: str, line: int = 0, column: int = 0) -> None:
        self.diagnostics.append({"severity": severity, "code": code, "message": message, "start_line": line, "start_column": column})
