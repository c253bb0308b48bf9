"""Java declarations by a small tokeniser (S7, a subset): packages, imports, types, heritage, fields, methods, and calls by name.

There is no type solver: parameters keep their source text, a receiver is resolved if it is ``this``, a type of the file, an
imported type, or a field or parameter of such a type; other calls are left out.
"""

from __future__ import annotations

import re

from ..functions.names import package_of, signature, simple_name

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|@interface\b|[A-Za-z_$][\w$]*|\d[\w.]*|\.\.\.|::|->|[^\s]', re.S)
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
_KINDS = {"class": "Class", "interface": "Interface", "enum": "Class", "record": "Class", "@interface": "Annotation"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "throw", "assert", "super", "this", "try", "do", "else", "case", "yield"}


class _Java:
    def __init__(self, path: str, text: str):
        self.rows: list[dict] = []
        self.tokens: list[tuple[str, int]] = []
        line, last = 1, 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", last, m.start())
            last = m.start()
            if not m.group().startswith(("//", "/*")):
                self.tokens.append((m.group(), line))
        self.i, self.package, self.imports = 0, "", {}
        self.local: dict[str, str] = {}

    def word(self, k: int = 0) -> str:
        return self.tokens[self.i + k][0] if self.i + k < len(self.tokens) else ""

    def line(self, k: int = 0) -> int:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)][1] if self.tokens else 0

    def emit(self, record: str, **fields) -> None:
        self.rows.append({"record": record, "language": "java", "package": self.package} | fields)

    def name(self) -> str:
        parts = [self.word()]
        self.i += 1
        while self.word() == "." and re.match(r"[\w$*]", self.word(1)):
            parts.append(self.word(1))
            self.i += 2
        return ".".join(parts)

    def skip(self, open_: str, close: str) -> list[tuple[str, int]]:
        """What stands between a bracket and its match."""
        depth, start = 0, self.i
        while self.i < len(self.tokens):
            w = self.word()
            depth += (w == open_) - (w == close)
            self.i += 1
            if not depth:
                break
        return self.tokens[start + 1 : self.i - 1]

    def type_text(self) -> str:
        text = self.name()
        if self.word() == "<":
            self.skip("<", ">")
        while self.word() == "[" or self.word() == "...":
            if self.word() == "...":
                self.i += 1
            else:
                self.skip("[", "]")
            text += "[]"
        return text

    def fqn(self, name: str) -> str:
        head, _, rest = name.partition(".")
        base = self.local.get(head) or self.imports.get(head)
        return (base + ("$" + rest.replace(".", "$") if rest else "")) if base else name

    def run(self) -> list[dict]:
        for k in range(len(self.tokens) - 1):  # types of the file, by simple name
            if self.tokens[k][0] in _KINDS and re.match(r"[A-Za-z_]", self.tokens[k + 1][0]):
                self.local.setdefault(self.tokens[k + 1][0], "")
        while self.i < len(self.tokens):
            if self.word() == "package":
                self.i += 1
                self.package = self.name()
            elif self.word() == "import":
                self.i += 1
                if self.word() == "static":
                    self.i += 1
                    self.name()
                elif not (full := self.name()).endswith("*"):
                    self.imports[simple_name(full)] = full
            elif self.word() == ";":
                self.i += 1
            else:
                self.local = {n: self.local[n] or (f"{self.package}.{n}" if self.package else n) for n in self.local}
                if not self.declaration(None, "Class"):
                    self.i += 1
        return self.rows

    def modifiers(self) -> tuple[set[str], list[str], int]:
        found, annotations, start = set(), [], self.line()
        while True:
            if self.word() == "@" and re.match(r"\w", self.word(1)):
                self.i += 1
                annotations.append(self.name())
                if self.word() == "(":
                    self.skip("(", ")")
            elif self.word() in _MODIFIERS:
                found.add(self.word())
                self.i += 1
            elif self.word() == "non" and self.word(1) == "-":
                self.i += 3
            else:
                return found, annotations, start

    def visibility(self, mods: set[str], default: str = "package") -> str:
        return next((m for m in ("public", "protected", "private") if m in mods), default)

    def declaration(self, owner: str | None, owner_label: str) -> bool:
        mods, annotations, start = self.modifiers()
        kind = self.word()
        if kind not in _KINDS or not re.match(r"[A-Za-z_$]", self.word(1)):
            return False
        self.i += 1
        simple = self.word()
        self.i += 1
        fqn = f"{owner}${simple}" if owner else f"{self.package}.{simple}" if self.package else simple
        self.local[simple] = fqn
        label = _KINDS[kind]
        if self.word() == "<":
            self.skip("<", ">")
        components = self.params(self.skip("(", ")")) if kind == "record" and self.word() == "(" else []
        heritage: list[tuple[str, str]] = []
        while self.word() in ("extends", "implements", "permits"):
            word = self.word()
            self.i += 1
            while True:
                t = self.type_text()
                if word != "permits":
                    heritage.append(("implements" if word == "implements" else "interfaceExtends" if label == "Interface" else "classExtends", t))
                if self.word() != ",":
                    break
                self.i += 1
        body_at = self.i
        self.emit("type", label=label, fqn=fqn, name=simple, kind={"@interface": "annotation"}.get(kind, kind), visibility=self.visibility(mods), is_abstract="abstract" in mods or label == "Interface", is_enum=kind == "enum", is_record=kind == "record", is_final="final" in mods, start_line=start)
        for relation, t in heritage:
            self.emit("relation", relation=relation, child=fqn, target=self.fqn(t), target_name=simple_name(t))
        for a in annotations:
            self.emit("annotation", owner=fqn, owner_kind={"Class": "class", "Interface": "interface", "Annotation": "annotation"}[label], annotation=self.fqn(a), name=simple_name(a))
        if self.word() != "{":
            return True
        self.i = body_at + 1
        owner_kind = {"Class": "class", "Interface": "interface", "Annotation": "annotation"}[label]
        for t, n in components:
            self.member_field(fqn, owner_kind, n, t, {"private", "final"}, self.line())
            self.method(fqn, owner_kind, n, t, [], {"public"}, start, start, synthetic=True)
        if components:
            self.method(fqn, owner_kind, "<init>", "", [t for t, _ in components], {"public"}, start, start, synthetic=True)
        if kind == "enum":
            while re.match(r"[A-Za-z_@]", self.word()):
                self.modifiers()
                self.member_field(fqn, owner_kind, self.word(), simple, {"public", "static", "final"}, self.line(), "enum-constant")
                self.i += 1
                if self.word() == "(":
                    self.skip("(", ")")
                if self.word() == "{":
                    self.skip("{", "}")
                if self.word() != ",":
                    break
                self.i += 1
        constructors = bool(components)
        bodies: list[tuple[str, list, list]] = []
        fields: dict[str, str] = dict((n, t) for t, n in components)
        while self.i < len(self.tokens) and self.word() != "}":
            if self.word() in (";", ","):
                self.i += 1
                continue
            at = self.i
            if self.declaration(fqn, label):
                continue
            self.i = at
            constructors |= self.member(fqn, simple, owner_kind, label, bodies, fields)
            if self.i == at:
                self.i += 1
        self.i += 1
        if label == "Class" and kind == "class" and not constructors:
            self.method(fqn, owner_kind, "<init>", "", [], {"public"}, 0, 0, synthetic=True)
        for sig, params, tokens in bodies:
            self.body_calls(sig, fqn, dict(fields) | {n: t for t, n in params}, tokens)
        return True

    def params(self, tokens) -> list[tuple[str, str]]:
        inner = _Java("", "")
        out, part, depth = [], [], 0
        for t in [*tokens, (",", 0)]:
            depth += (t[0] in "<([") - (t[0] in ">)]") if len(t[0]) == 1 else 0
            if t[0] == "," and not depth:
                if part:
                    inner.tokens, inner.i = part, 0
                    inner.modifiers()
                    kind = inner.type_text()
                    out.append((kind, inner.word() or kind))
                part = []
            else:
                part.append(t)
        return out

    def member_field(self, owner, owner_kind, name, type_, mods, line, kind="field") -> None:
        self.emit("member", label="Field", owner=owner, owner_kind=owner_kind, fqn=f"{owner}#{name}", name=name, kind=kind, type=type_, visibility=self.visibility(mods), is_static="static" in mods, start_line=line, end_line=line)

    def method(self, owner, owner_kind, name, type_, params, mods, start, end, synthetic=False, default="package") -> str:
        sig = signature(owner, name, params)
        self.emit("member", label="Method", owner=owner, owner_kind=owner_kind, signature=sig, name=name, kind="constructor" if name == "<init>" else "method", type=type_, visibility=self.visibility(mods, default), is_static="static" in mods, is_synthetic=synthetic, start_line=start, end_line=end)
        return sig

    def member(self, owner, simple, owner_kind, label, bodies, fields) -> bool:
        mods, annotations, start = self.modifiers()
        if self.word() == "{":  # initialiser
            self.skip("{", "}")
            return False
        if self.word() == "<":
            self.skip("<", ">")
        if self.word() == simple and self.word(1) in ("(", "{"):
            self.i += 1
            name, type_ = "<init>", ""
            params = self.params(self.skip("(", ")")) if self.word() == "(" else []
        else:
            if not re.match(r"[A-Za-z_$]", self.word()):
                return False
            type_ = self.type_text()
            name = self.word()
            if not re.match(r"[A-Za-z_$]", name):
                return False
            self.i += 1
            if self.word() != "(":
                while True:
                    self.member_field(owner, owner_kind, name, type_, mods, start)
                    fields[name] = type_
                    for a in annotations:
                        self.emit("annotation", owner=f"{owner}#{name}", owner_kind="field", annotation=self.fqn(a), name=simple_name(a))
                    depth = 0
                    while self.i < len(self.tokens) and not (depth == 0 and self.word() in (",", ";")):
                        depth += (self.word() in ("(", "{", "[")) - (self.word() in (")", "}", "]"))
                        self.i += 1
                    if self.word() == "," and re.match(r"[A-Za-z_$]", self.word(1)) and self.word(2) in ("=", ",", ";"):
                        name = self.word(1)
                        self.i += 2
                        continue
                    return False
            params = self.params(self.skip("(", ")"))
        while self.i < len(self.tokens) and self.word() not in ("{", ";", "}"):
            self.i += 1
        body = self.skip("{", "}") if self.word() == "{" else []
        end = self.line(-1) if body or self.word(-1) == "}" else self.line()
        sig = self.method(owner, owner_kind, name, type_, [t for t, _ in params], mods, start, end, default="public" if label != "Class" else "package")
        for a in annotations:
            self.emit("annotation", owner=sig, owner_kind="method", annotation=self.fqn(a), name=simple_name(a))
        bodies.append((sig, params, body))
        return name == "<init>"

    def body_calls(self, caller: str, owner: str, variables: dict[str, str], tokens) -> None:
        words = [t for t, _ in tokens]
        named = lambda o, n, loose=False: self.emit("callByName", caller=caller, callee_owner=o, callee_name=n, allow_name_only=loose)
        lambdas = {words[k - 1] for k, w in enumerate(words) if w == "->" and k}
        for k, w in enumerate(words):
            if k + 2 < len(words) and re.match(r"[A-Z]", w) and re.match(r"[a-z_]\w*$", words[k + 1]) and words[k + 2] in ("=", ";", ":"):
                variables[words[k + 1]] = w
            if k + 1 >= len(words) or words[k + 1] != "(" or not re.match(r"[A-Za-z_$]", w) or w in _NOT_CALLS:
                continue
            before = words[k - 1] if k else ""
            if before == "new":
                named(self.fqn(w), "<init>")
            elif before != ".":
                named(owner, w)
            elif k >= 2 and re.match(r"[A-Za-z_$]", words[k - 2]) and (k < 3 or words[k - 3] != "."):
                receiver = words[k - 2]
                if receiver == "this":
                    named(owner, w)
                elif receiver in lambdas:
                    named("", w, True)
                elif receiver in variables and self.fqn(variables[receiver]) != variables[receiver]:
                    named(self.fqn(variables[receiver]), w)
                elif self.fqn(receiver) != receiver:
                    named(self.fqn(receiver), w)


def parse(path: str, text: str, known: dict) -> list[dict]:
    """The records of one file. A file without any declaration has none."""
    found = _Java(path, text).run()
    return [r | {"target_name": r.get("target_name") or simple_name(r.get("target", "") or "")} if r["record"] == "relation" else r for r in found]


__all__ = ["package_of", "parse"]
