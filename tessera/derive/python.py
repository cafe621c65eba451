"""Facts of Python files, by the standard parser: declarations, bindings, imports, calls and bases.

What a file alone decides (scopes, keys, which binding a name means) is decided here; what needs other files is left as
a dotted path for :mod:`tessera.derive.resolve`.
"""

from __future__ import annotations

import ast
import bisect
import re

MAX_DIAGNOSTICS = 16


def module_of(path: str) -> str | None:
    parts = path[:-3].split("/")
    parts = parts[:-1] if parts[-1] == "__init__" else parts
    return ".".join(parts) if parts and all(p.isidentifier() for p in parts) else None


class _Scope:
    def __init__(self, node, parent, kind: str, key: str) -> None:
        self.node, self.parent, self.kind, self.key = node, parent, kind, key
        self.bound: dict[str, list[tuple]] = {}  # name -> ('symbol', key) | ('import', dotted) | ('value',)
        self.opaque: set[str] = set()
        self.star = False
        self.first: str | None = None  # the receiver of a method


def _dotted(node) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super" and not node.args and parts:
        return ".".join(["super()", *reversed(parts)])
    return None


class Parser(ast.NodeVisitor):
    def __init__(self, path: str, text: str) -> None:
        self.path, self.raw = path, text.encode()
        self.lines = [0, *(m.end() for m in re.finditer(rb"\n", self.raw))]
        self.module = module_of(path)
        self.top = _Scope(None, None, "file", f"file:{path}")
        self.scope = self.top
        self.symbols: list[tuple] = []
        self.uses: list[tuple] = []  # (scope, relation, text, dotted, start, end)
        self.names: dict[str, int] = {}
        self.exports: list[tuple[str, str]] = []

    def at(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def span(self, node) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def bind(self, name: str, what: tuple) -> None:
        self.scope.bound.setdefault(name, []).append(what)

    def declare(self, node, cls: bool) -> None:
        start, end = self.span(node)
        if node.decorator_list:
            first = self.at(node.decorator_list[0].lineno, node.decorator_list[0].col_offset)
            start = self.raw.rfind(b"@", 0, first)
        outer = self.scope
        base = f"symbol:{self.path}#" if outer is self.top else outer.key + "."
        n = self.names.get(base + node.name, 0)
        self.names[base + node.name] = n + 1
        key = base + node.name + (f"~{n}" if n else "")
        kind = "class" if cls else "method" if outer.kind == "class" else "function"
        def_at, body = self.at(node.lineno, node.col_offset), self.at(node.body[0].lineno, node.body[0].col_offset)
        if node.body[0].__class__ in (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef) and node.body[0].decorator_list:
            body = self.raw.rfind(b"@", 0, self.at(node.body[0].decorator_list[0].lineno, node.body[0].decorator_list[0].col_offset))
        signature = self.raw[def_at:body].decode("utf-8", "replace").strip()
        signature = re.sub(r":\s*(#[^\n]*)?$", "", signature).strip()
        self.symbols.append((key, outer.key, kind, node.name, signature, start, end, self.is_test(outer, node.name, cls)))
        self.bind(node.name, ("symbol", key))
        for d in node.decorator_list:
            self.visit(d)
        if cls:
            for b in [*node.bases, *(k.value for k in node.keywords)]:
                if (name := _dotted(b)) is not None and b in node.bases:
                    self.uses.append((outer, key, "references", name, *self.span(b)))
                self.visit(b)
        else:
            for d in [*node.args.defaults, *(x for x in node.args.kw_defaults if x is not None)]:
                self.visit(d)
        self.scope = _Scope(node, outer, "class" if cls else "function", key)
        if not cls:
            every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *(x for x in (node.args.vararg, node.args.kwarg) if x)]
            for a in every:
                self.bind(a.arg, ("value",))
            if outer.kind == "class" and every and not any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list):
                self.scope.first = every[0].arg
        for x in node.body:
            self.visit(x)
        self.scope = outer

    def is_test(self, outer: _Scope, name: str, cls: bool) -> bool:
        file = self.path.rsplit("/", 1)[-1]
        if not (file.startswith("test_") or file.endswith("_test.py")):
            return False
        if outer is self.top:
            return name.startswith("Test" if cls else "test")
        return not cls and name.startswith("test") and outer.kind == "class" and outer.parent is self.top and outer.node.name.startswith("Test")

    def visit_FunctionDef(self, node) -> None:
        self.declare(node, False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self.declare(node, True)

    def visit_Lambda(self, node) -> None:
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *(x for x in (node.args.vararg, node.args.kwarg) if x)]:
            self.bind(a.arg, ("value",))
        self.generic_visit(node)

    def visit_Name(self, node) -> None:
        if not isinstance(node.ctx, ast.Load):
            self.bind(node.id, ("value",))

    def visit_ExceptHandler(self, node) -> None:
        if node.name:
            self.bind(node.name, ("value",))
        self.generic_visit(node)

    def visit_MatchAs(self, node) -> None:
        if node.name:
            self.bind(node.name, ("value",))
        self.generic_visit(node)

    def visit_MatchStar(self, node) -> None:
        if node.name:
            self.bind(node.name, ("value",))

    def visit_Global(self, node) -> None:
        self.top.opaque.update(node.names)
        self.scope.opaque.update(node.names)

    visit_Nonlocal = visit_Global

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.uses.append((None, self.scope.key, "imports", a.name, *self.span(node)))
            self.bind(a.asname or a.name.split(".")[0], ("import", a.name if a.asname else a.name.split(".")[0]))

    def visit_ImportFrom(self, node) -> None:
        base = node.module or ""
        if node.level:
            own = (self.module or "").split(".") if self.module else []
            if not self.path.endswith("__init__.py"):
                own = own[:-1]
            own = own[: len(own) - (node.level - 1)] if node.level > 1 else own
            base = ".".join([*own, *([node.module] if node.module else [])]) if self.module is not None else ""
        for a in node.names:
            if a.name == "*":
                self.scope.star = True
                self.uses.append((None, self.scope.key, "imports", base, *self.span(node)))
                continue
            dotted = f"{base}.{a.name}" if base else a.name if not node.level else ""
            self.uses.append((None, self.scope.key, "imports", dotted or a.name, *self.span(node)))
            self.bind(a.asname or a.name, ("import", dotted) if dotted else ("value",))

    def visit_Call(self, node) -> None:
        if (name := _dotted(node.func)) is not None:
            self.uses.append((self.scope, self.scope.key, "calls", name, *self.span(node)))
        self.generic_visit(node)

    def meaning(self, scope: _Scope, name: str) -> tuple[list[str], str | None, bool]:
        """(keys in this file, dotted path elsewhere, a guess by the receiver) that a dotted name means in a scope."""
        head, *rest = name.split(".")
        s, inner = scope, True
        if head == "super()":
            return [], None, False
        while s is not None:
            if s.first == head and rest and s.parent is not None and s.parent.kind == "class":
                found = [k for k in self.keys_of(s.parent, rest[0])] if len(rest) == 1 else []
                return found, None, bool(found)
            if (s.kind != "class" or inner) and (head in s.bound or head in s.opaque):
                kinds = {x[0] for x in s.bound.get(head, [])}
                if head in s.opaque or len(kinds) != 1 or kinds == {"value"}:
                    return [], None, False
                if kinds == {"import"}:
                    dotted = {x[1] for x in s.bound[head]}
                    return ([], ".".join([dotted.pop(), *rest]), False) if len(dotted) == 1 else ([], None, False)
                keys = [x[1] for x in s.bound[head]]
                for part in rest:
                    keys = [k for key in keys for k in self.members.get((key, part), [])]
                return keys, None, False
            if s.star:
                return [], None, False
            inner = inner and s.kind == "class" and False
            s = s.parent
        return [], None, False

    def keys_of(self, cls: _Scope, name: str) -> list[str]:
        what = cls.bound.get(name, [])
        return [x[1] for x in what if x[0] == "symbol"] if what and all(x[0] == "symbol" for x in what) else []

    def facts(self, tree) -> dict:
        for x in tree.body:
            self.visit(x)
        self.members: dict[tuple[str, str], list[str]] = {}
        for key, parent, _, name, *_ in self.symbols:
            self.members.setdefault((parent, name), []).append(key)
        uses = []
        for scope, source, relation, text, start, end in self.uses:
            keys, dotted, guess = ([], text, False) if relation == "imports" else self.meaning(scope, text)
            uses.append((relation, source, text, keys, dotted, guess, start, end))
        exports = [(n, x[1]) for n, what in self.top.bound.items() for x in what if {y[0] for y in what} == {"import"} and n not in self.top.opaque]
        return {"symbols": self.symbols, "uses": sorted(uses, key=lambda u: (u[6], u[7], u[0])), "exports": exports, "coverage": "complete", "diagnostics": []}


def parse(path: str, data: bytes) -> dict:
    """Symbols, uses and re-exported imports of one file; what cannot be parsed is cut at the line of the error, up to
    ``MAX_DIAGNOSTICS`` times, and the file is partial."""
    none = {"symbols": [], "uses": [], "exports": [], "coverage": "unsupported", "diagnostics": []}
    try:
        text = data.decode("utf-8-sig" if data[:3] == b"\xef\xbb\xbf" else "utf-8")
    except UnicodeDecodeError as e:
        return none | {"diagnostics": [f"not UTF-8: {e.reason} at byte {e.start}"]}
    notes: list[str] = []
    lines = text.split("\n")
    for _ in range(MAX_DIAGNOSTICS + 1):
        try:
            tree = ast.parse("\n".join(lines))
            got = Parser(path, "\n".join(lines)).facts(tree)
            return got if not notes else got | {"coverage": "partial", "diagnostics": notes[:MAX_DIAGNOSTICS] + ["more omitted"] * (len(notes) > MAX_DIAGNOSTICS)}
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            notes.append(f"line {at + 1}: {e.msg}")
            # The top-level statement around the error is blanked, so that offsets stay.
            first = next((i for i in range(at, -1, -1) if lines[i][:1] not in ("", " ", "\t", "#", ")", "]", "}")), 0)
            last = next((i for i in range(at + 1, len(lines)) if lines[i][:1] not in ("", " ", "\t", "#", ")", "]", "}")), len(lines))
            if all(not x.strip() for x in lines[first:last]):
                break
            lines[first:last] = [" " * len(x.encode()) for x in lines[first:last]]
        except (RecursionError, ValueError, MemoryError) as e:
            return none | {"diagnostics": [f"{type(e).__name__}: nested too deeply or not parseable"]}
    return none | {"coverage": "partial", "diagnostics": notes[:MAX_DIAGNOSTICS]}


def innermost(spans: list[tuple[int, int]], at: int) -> int:
    """Index of the smallest span, of spans sorted by start, that holds a place; -1 if none does."""
    best = -1
    for i in range(bisect.bisect_right(spans, (at, 1 << 62)) - 1, -1, -1):
        if spans[i][0] <= at < spans[i][1] and (best < 0 or spans[i][1] - spans[i][0] < spans[best][1] - spans[best][0]):
            best = i
    return best
