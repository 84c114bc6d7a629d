"""Python sources, by the standard library's syntax tree."""

from __future__ import annotations

import ast

from .builder import Builder, Result

SUFFIXES = (".py", ".pyi")
# Names that stand for effects.
VERBS = frozenset("get post put patch delete head options".split())
CLIENTS = frozenset("requests httpx aiohttp urllib3".split())
PUBLISH, SUBSCRIBE = frozenset("publish publish_event emit produce".split()), frozenset("subscribe on consume".split())
BUILTINS = frozenset("int str float bool bytes list dict set tuple object None Any".split())
WRAPPERS = frozenset("Optional ClassVar Final Annotated".split())


def module_name(path: str) -> str:
    return path.rsplit(".", 1)[0].removesuffix("/__init__").replace("/", ".")


def literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
        return f"{head}.{node.attr}"
    return ""


def type_name(node: ast.AST | None) -> str:
    """The one class that an annotation names, or ''."""
    if node is None:
        return ""
    if (text := literal(node)) is not None:
        try:
            return type_name(ast.parse(text, mode="eval").body)
        except SyntaxError:
            return ""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return type_name(node.left) or type_name(node.right)
    if isinstance(node, ast.Subscript):
        inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) else node.slice
        return type_name(inner) if dotted(node.value).rsplit(".", 1)[-1] in WRAPPERS else ""
    name = dotted(node)
    return "" if name in BUILTINS else name


class _Scope:
    def __init__(self, id_: str, name: str, cls: str = "", cls_id: str = ""):
        self.id, self.name, self.cls, self.cls_id = id_, name, cls, cls_id
        self.variables: dict[str, str] = {}
        self.types: dict[str, str] = {}


class _Visitor(ast.NodeVisitor):
    def __init__(self, builder: Builder):
        self.b, self.module = builder, module_name(builder.path)
        self.imports: dict[str, str] = {}
        self.scope = _Scope(builder.file, self.module)
        self.in_class = False

    def _resolved(self, name: str) -> str:
        head, _, rest = name.partition(".")
        if head in ("self", "cls") and self.scope.cls and rest:
            return f"{self.scope.cls}.{rest}"
        known = self.scope.types.get(head) or self.imports.get(head)
        return f"{known}.{rest}" if known and rest else known or name

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.b.fact("imports", self.b.file, a.name, "module", node.lineno, alias=a.asname or "")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            parent = self.module.split(".")[: -node.level] if not self.b.path.endswith("__init__.py") else self.module.split(".")[: len(self.module.split(".")) - node.level + 1]
            base = ".".join([*parent, *([base] if base else [])])
        for a in node.names:
            if a.name != "*":
                self.imports[a.asname or a.name] = f"{base}.{a.name}"
            self.b.fact("imports", self.b.file, base, "module", node.lineno, alias=a.asname or "", symbol=a.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        qualified = f"{self.scope.name}.{node.name}"
        key = self.b.declare(self.scope.id, "class", node.name, qualified, node.lineno, node.end_lineno or 0)
        for base in node.bases:
            if name := dotted(base):
                self.b.fact("extends", key, self._resolved(name), "class", node.lineno)
        self._decorate(node, key)
        outer, inside = self.scope, self.in_class
        self.scope, self.in_class = _Scope(key, qualified, qualified, key), True
        for child in node.body:
            self.visit(child)
        self.scope, self.in_class = outer, inside

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        kind = "method" if self.in_class else "function"
        test = node.name.startswith("test_") and (self.b.path.rsplit("/", 1)[-1].startswith("test_") or self.b.path.endswith("_test.py"))
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        qualified = f"{self.scope.name}.{node.name}"
        key = self.b.declare(
            self.scope.id, "test" if test else kind, node.name, qualified, node.lineno, node.end_lineno or 0,
            parameters=", ".join(a.arg for a in args), returns=ast.unparse(node.returns) if node.returns else "", **{"async": "true" if isinstance(node, ast.AsyncFunctionDef) else ""},
        )
        self._decorate(node, key)
        outer, inside = self.scope, self.in_class
        self.scope, self.in_class = _Scope(key, qualified, outer.cls, outer.cls_id), False
        self.scope.types |= {} if outer.cls else outer.types
        for a in args:
            if a.arg not in ("self", "cls"):
                self.scope.variables[a.arg] = self.b.declare(key, "parameter", a.arg, f"{qualified}.{a.arg}", a.lineno)
                if t := type_name(a.annotation):
                    self.scope.types[a.arg] = self._resolved(t)
        for child in node.body:
            self.visit(child)
        self.scope, self.in_class = outer, inside

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _decorate(self, node: ast.AST, key: str) -> None:
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            last = dotted(call.func if call else d).rsplit(".", 1)[-1]
            first = literal(call.args[0]) if call and call.args else None
            if last.lower() in VERBS and first and first.startswith("/"):
                e = self.b.endpoint(last.upper(), first, d.lineno)
                self.b.fact("exposes", self.b.file, target_id=e, line=d.lineno)
                self.b.fact("handled_by", e, target_id=key, line=d.lineno, handler=node.name)
            elif last in SUBSCRIBE and first:
                self.b.fact("subscribes", key, first, "event", d.lineno)
            if call:
                for a in call.args:
                    self.visit(a)

    def _assign(self, targets: list[ast.AST], value: ast.AST | None, line: int, annotation: ast.AST | None = None) -> None:
        used = [n.id for n in ast.walk(value) if isinstance(n, ast.Name) and n.id in self.scope.variables] if value else []
        for t in targets:
            name = dotted(t)
            head, _, rest = name.partition(".")
            if self.in_class and name and not rest:
                key = self.b.node("field", name, f"{self.scope.name}.{name}", line)
                self.b.fact("has_field", self.scope.id, target_id=key, line=line)
            elif head in ("self", "cls") and rest and "." not in rest and self.scope.cls:
                key = self.b.node("field", rest, f"{self.scope.cls}.{rest}", line)
                self.b.fact("has_field", self.scope.cls_id, target_id=key, line=line)
            elif isinstance(t, ast.Name):
                key = self.b.declare(self.scope.id, "variable", name, f"{self.scope.name}.{name}@{line}", line)
                self.scope.variables[name] = key
                made = type_name(annotation) or (dotted(value.func) if isinstance(value, ast.Call) else "")
                if made and made.rsplit(".", 1)[-1][:1].isupper():
                    self.scope.types[name] = self._resolved(made)
            else:
                continue
            for u in dict.fromkeys(used):
                if self.scope.variables[u] != key:
                    self.b.fact("assigns", self.scope.variables[u], target_id=key, line=line)
        if value:
            self.visit(value)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assign(node.targets, node.value, node.lineno)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assign([node.target], node.value, node.lineno, node.annotation)

    def visit_Return(self, node: ast.Return) -> None:
        for n in ast.walk(node):
            if isinstance(n, ast.Name) and n.id in self.scope.variables:
                self.b.fact("returns", self.scope.variables[n.id], target_id=self.scope.id, line=node.lineno)
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if dotted(node.value) == "os.environ" and (key := literal(node.slice)):
            self.b.fact("reads_config", self.scope.id, key, "config_key", node.lineno)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name, line = dotted(node.func), node.lineno
        head, _, last = name.rpartition(".")
        first = literal(node.args[0]) if node.args else None
        second = literal(node.args[1]) if len(node.args) > 1 else None
        client = head.split(".")[0] in CLIENTS
        if name in ("os.getenv", "os.environ.get") and first:
            self.b.fact("reads_config", self.scope.id, first, "config_key", line)
        elif client and last == "request" and first and second:
            self.b.fact("requests", self.scope.id, f"{first.upper()} {second}", "endpoint", line)
        elif client and last in VERBS and first:
            self.b.fact("requests", self.scope.id, f"{last.upper()} {first}", "endpoint", line)
        elif head and last in VERBS and len(node.args) > 1 and first and first.startswith("/"):
            e = self.b.endpoint(last.upper(), first, line)
            self.b.fact("exposes", self.b.file, target_id=e, line=line)
            if handler := dotted(node.args[-1]):
                self.b.fact("handled_by", e, self._resolved(handler), line=line, handler=handler)
        elif last in PUBLISH and first:
            self.b.fact("publishes", self.scope.id, first, "event", line)
        elif last in SUBSCRIBE and head and first:
            self.b.fact("subscribes", self.scope.id, first, "event", line)
        elif name:
            target = self._resolved(name)
            if target == name and "." not in name:
                target = f"{self.module}.{name}"
            for i, a in enumerate(node.args):
                if isinstance(a, ast.Name) and a.id in self.scope.variables:
                    self.b.fact("passes", self.scope.variables[a.id], target, line=line, argument=str(i))
            self.b.fact("calls", self.scope.id, target, line=line)
        self.generic_visit(node)


def parse(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "python", text.count("\n") + 1)
    b.node("module", module_name(path).rsplit(".", 1)[-1], module_name(path), 1)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        b.problem(getattr(e, "lineno", 1) or 1, "error", str(e))
        return b.result()
    _Visitor(b).visit(tree)
    return b.result()
