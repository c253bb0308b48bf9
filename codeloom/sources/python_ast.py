"""Python files to records by the standard ``ast``.

Names: module ``python.<folders>.<file>`` encoded; members ``owner.name()`` and ``owner#field``; ``__init__`` is ``<init>``. Calls are
resolved within the module, by its imports, by ``self``, and by module functions; what can't be named is left out. Nested
functions, lambdas and classes are not part of the function around them.
"""

from __future__ import annotations

import ast
import posixpath

from ..functions.names import PY_SUFFIXES, module_fqn, package_fqn, signature

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _visibility(name: str) -> str:
    if name.startswith("__") and name.endswith("__"):
        return "public"
    return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


def _dotted(node: ast.AST) -> list[str] | None:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *parts[::-1]] if isinstance(node, ast.Name) else None


class _Module:
    def __init__(self, path: str, text: str, known: dict):
        self.path, self.tree = path, ast.parse(text)
        self.fqn, self.package = module_fqn("python", path), package_fqn("python", path)
        self.files = known.get("files", frozenset())
        self.rows: list[dict] = []
        self.functions: set[str] = {n.name for n in self.tree.body if isinstance(n, _FUNCTIONS)}
        self.classes: dict[str, str] = {}
        self.methods: dict[str, set[str]] = {}
        self.imports: dict[str, tuple[str, str | None]] = {}  # local name to (module fqn, symbol)

    def emit(self, record: str, **fields) -> None:
        self.rows.append({"record": record, "language": "python", "package": self.package, "module": self.fqn} | fields)

    def module_path(self, dotted: str, level: int) -> str | None:
        """The file that an import names, if it is one of the project's."""
        folder = posixpath.dirname(self.path)
        if level:
            for _ in range(level - 1):
                folder = posixpath.dirname(folder)
            base = posixpath.join(folder, *dotted.split(".")) if dotted else folder
            bases = [base]
        else:
            bases = [dotted.replace(".", "/")]
            if folder:
                bases.append(posixpath.join(folder, bases[0]))
        for base in bases:
            for suffix in PY_SUFFIXES:
                if (found := f"{base}{suffix}".lstrip("/")) in self.files:
                    return found
        return None

    def read_imports(self, nodes) -> dict[str, tuple[str, str | None]]:
        found = {}
        for node in nodes:
            if isinstance(node, ast.Import):
                for a in node.names:
                    if (p := self.module_path(a.name, 0)) and (a.asname or "." not in a.name):
                        found[a.asname or a.name] = (module_fqn("python", p), None)
            elif isinstance(node, ast.ImportFrom):
                here = self.module_path(node.module or "", node.level)
                for a in node.names:
                    inner = self.module_path(f"{node.module}.{a.name}" if node.module else a.name, node.level)
                    if inner:
                        found[a.asname or a.name] = (module_fqn("python", inner), None)
                    elif here:
                        found[a.asname or a.name] = (module_fqn("python", here), a.name)
        return found

    def target(self, parts: list[str], local: dict) -> str | None:
        """The fqn that a dotted name of a type stands for."""
        if parts[0] in self.classes:
            return ".".join([self.classes[parts[0]], *parts[1:]])
        if (found := local.get(parts[0])) is not None:
            module, symbol = found
            return ".".join([module, *([symbol] if symbol else []), *parts[1:]])
        return None

    def classes_of(self, body, owner: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                fqn = f"{owner}.{node.name}"
                if owner == self.fqn:
                    self.classes[node.name] = fqn
                self.methods[fqn] = {n.name for n in node.body if isinstance(n, _FUNCTIONS)}
                self.classes_of(node.body, fqn)

    def annotate(self, node, key: str, kind: str) -> None:
        for d in node.decorator_list:
            parts = _dotted(d.func if isinstance(d, ast.Call) else d)
            if parts:
                name = self.target(parts, self.imports) or ".".join(parts)
                self.emit("annotation", owner=key, owner_kind=kind, annotation=name, name=parts[-1])

    def calls(self, node, caller: str, owner: str | None) -> None:
        local = self.imports | self.read_imports(n for n in ast.walk(node) if isinstance(n, (ast.Import, ast.ImportFrom)))
        todo = list(node.body)
        while todo:
            n = todo.pop(0)
            if isinstance(n, (*_FUNCTIONS, ast.Lambda, ast.ClassDef)):
                continue
            if isinstance(n, ast.Call):
                self.call(n, caller, owner, local)
            todo[:0] = list(ast.iter_child_nodes(n))

    def call(self, node: ast.Call, caller: str, owner: str | None, local: dict) -> None:
        parts = _dotted(node.func)
        named = lambda o, n: self.emit("callByName", caller=caller, callee_owner=o, callee_name=n, allow_name_only=False)
        if parts is None:
            return
        name = parts[-1]
        if len(parts) == 1:
            if name in self.functions:
                self.emit("call", caller=caller, callee=signature(self.fqn, name))
            elif name in self.classes:
                named(self.classes[name], "<init>")
            elif name in local and local[name][1]:
                module, symbol = local[name]
                named(f"{module}.{symbol}", "<init>") if symbol[:1].isupper() else named(module, symbol)
        elif parts[0] in ("self", "cls") and owner and len(parts) == 2:
            if name in self.methods.get(owner, ()):
                self.emit("call", caller=caller, callee=signature(owner, "<init>" if name == "__init__" else name))
            else:
                named(owner, name)
        elif (found := self.target(parts[:-1], local)) is not None:
            module_only = parts[0] in local and local[parts[0]][1] is None and len(parts) == 2
            named(f"{found}.{name}", "<init>") if module_only and name[:1].isupper() else named(found, name)

    def function(self, node, owner: str, kind: str, members: list[dict]) -> None:
        init = kind == "method" and node.name == "__init__"
        name = "<init>" if init else node.name
        sig = signature(owner, name)
        static = any(_dotted(d) == ["staticmethod"] for d in node.decorator_list)
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        members.append(dict(label="Method", owner=owner, owner_kind="class", signature=sig, name=name, kind="constructor" if init else kind, type=ast.unparse(node.returns) if node.returns else "", visibility="public" if init else _visibility(node.name), is_static=static or kind == "function", is_synthetic=False, start_line=first, end_line=node.end_lineno))
        self.annotate(node, sig, "method")

    def field(self, owner: str, name: str, members: list[dict], type_: str = "", static: bool = True, line: int = 0) -> None:
        fqn = f"{owner}#{name}"
        if not any(m.get("fqn") == fqn for m in members):
            members.append(dict(label="Field", owner=owner, owner_kind="class", fqn=fqn, name=name, kind="field", type=type_, visibility=_visibility(name), is_static=static, start_line=line, end_line=line))

    def fields_of(self, body, owner: str, members: list[dict]) -> None:
        for node in body:
            if isinstance(node, ast.Assign):
                for t in node.targets:
                    for x in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                        if isinstance(x, ast.Name):
                            self.field(owner, x.id, members, line=node.lineno)
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                self.field(owner, node.target.id, members, ast.unparse(node.annotation), line=node.lineno)

    def class_(self, node: ast.ClassDef, owner: str) -> None:
        fqn = f"{owner}.{node.name}"
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        abstract = any((_dotted(b) or [""])[-1] in ("ABC", "ABCMeta") for b in [*node.bases, *(k.value for k in node.keywords)])
        self.emit("type", label="Class", fqn=fqn, name=node.name, kind="class", visibility=_visibility(node.name), is_abstract=abstract, is_enum=False, is_record=False, is_final=False, start_line=first, end_line=node.end_lineno)
        for base in node.bases:
            if (parts := _dotted(base)) is not None:
                target = self.target(parts, self.imports) or ".".join(parts)
                self.emit("relation", relation="classExtends", child=fqn, target=target, target_name=parts[-1])
        self.annotate(node, fqn, "class")
        members: list[dict] = []
        self.fields_of(node.body, fqn, members)
        for n in node.body:
            if isinstance(n, _FUNCTIONS):
                self.function(n, fqn, "method", members)
                for x in ast.walk(n):
                    targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign) else []
                    for t in targets:
                        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                            self.field(fqn, t.attr, members, static=False, line=x.lineno)
        if not any(m.get("name") == "<init>" for m in members):
            members.append(dict(label="Method", owner=fqn, owner_kind="class", signature=signature(fqn, "<init>"), name="<init>", kind="constructor", type="", visibility="public", is_static=False, is_synthetic=True, start_line=0, end_line=0))
        for m in members:
            self.emit("member", **m)
        for n in node.body:
            if isinstance(n, _FUNCTIONS):
                self.calls(n, signature(fqn, "<init>" if n.name == "__init__" else n.name), fqn)
            elif isinstance(n, ast.ClassDef):
                self.class_(n, fqn)

    def run(self) -> list[dict]:
        self.imports = self.read_imports(n for n in self.tree.body if isinstance(n, (ast.Import, ast.ImportFrom)))
        self.classes_of(self.tree.body, self.fqn)
        name = posixpath.basename(self.path)
        self.emit("module", label="Class", fqn=self.fqn, name=name, kind="module", visibility="public", is_abstract=False, is_enum=False, is_record=False, is_final=False)
        members: list[dict] = [dict(label="Method", owner=self.fqn, owner_kind="class", signature=signature(self.fqn, "<init>"), name="<init>", kind="module", type="", visibility="public", is_static=True, is_synthetic=True, start_line=0, end_line=0)]
        self.fields_of(self.tree.body, self.fqn, members)
        for n in self.tree.body:
            if isinstance(n, _FUNCTIONS):
                self.function(n, self.fqn, "function", members)
        for m in members:
            self.emit("member", **m)
        for n in self.tree.body:
            if isinstance(n, _FUNCTIONS):
                self.calls(n, signature(self.fqn, n.name), None)
            elif isinstance(n, ast.ClassDef):
                self.class_(n, self.fqn)
        return self.rows


class _Asked(set):
    """No files; notes those that are looked for."""

    def __contains__(self, name: object) -> bool:
        self.add(name)
        return False


def asked_files(path: str, text: str) -> list[str]:
    """The relative paths that imports of a file could name; none if it can't be parsed."""
    asked = _Asked()
    try:
        _Module(path, text, {"files": asked}).run()
    except (ValueError, SyntaxError, RecursionError):
        return []
    return sorted(asked)


def parse(path: str, text: str, known: dict) -> list[dict]:
    """The records of one file; ``known["files"]`` are relative paths of the project, those that :func:`asked_files` names at least."""
    return _Module(path, text, known).run()
