"""Tag files to records (S11-S13): JSON tags of one file at a time, scopes resolved to a fix-point."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import encode_tag, tag_fqn, tag_params
from .records import SCHEMA, batch

INTERFACES = {"interface", "trait", "protocol"}
CLASSES = {"class", "struct", "union", "module", "namespace", "package", "object", "type", "typedef", "record", "implementation"}
ENUMS = {"enum"}
METHODS = {"method", "function", "func", "procedure", "subroutine", "singletonmethod", "prototype", "macro"}
CONSTRUCTORS = {"constructor"}
ENUM_MEMBERS = {"enumerator", "enumconstant", "enummember"}
FIELDS = {"field", "member", "variable", "constant", "property", "const", "var", "attribute"}
TAG = "name string, kind string, scope string, scopeKind string, signature string, typeref string, access string, static boolean, line int, end int"


def role(kind: str | None) -> str | None:
    """What a raw kind is: interface, class, enum, method, constructor, enum-member, field, or nothing."""
    low = (kind or "").lower().replace(" ", "").replace("-", "")
    groups = (("interface", INTERFACES), ("enum", ENUMS), ("class", CLASSES), ("constructor", CONSTRUCTORS), ("enum-member", ENUM_MEMBERS), ("method", METHODS), ("field", FIELDS))
    return next((name for name, kinds in groups if low in kinds), None)


def records(path: str, language: str, tags: list[dict]) -> list[dict]:
    """A type gets the owner that its scope names, whatever the order of the tags; one whose scope stays unknown belongs to the module."""
    module = tag_fqn(language, path)
    common = {"path": path, "language": language, "package": module.rpartition(".")[0], "module": module}
    types, members = [], []
    for t in tags:
        r = role(t.get("kind"))
        if r and t.get("name"):
            (types if r in ("interface", "class", "enum") else members).append((r, t))
    owner: dict[str, str] = {}
    open_ = types
    while open_:
        rest = []
        for r, t in open_:
            scope = t.get("scope") or ""
            if not scope or scope in owner:
                fqn = f"{owner[scope] if scope else module}.{encode_tag(t['name'])}"
                owner.setdefault(f"{scope}.{t['name']}" if scope else t["name"], fqn)
                owner.setdefault(t["name"], fqn)
                t["_fqn"] = fqn
            else:
                rest.append((r, t))
        if len(rest) == len(open_):
            for r, t in rest:
                t["_fqn"] = f"{module}.{encode_tag(t['name'])}"
                owner.setdefault(t["name"], t["_fqn"])
            break
        open_ = rest
    out = [common | {"record": "module", "label": "Class", "fqn": module, "name": path.rpartition("/")[2], "kind": "module", "visibility": "public"}]
    out.append(common | {"record": "member", "label": "Method", "owner": module, "owner_kind": "class", "signature": f"{module}.<init>()", "name": "<init>", "kind": "module", "is_static": True, "is_synthetic": True, "start_line": 0, "end_line": 0, "visibility": "public"})
    with_ctor = {owner.get(t.get("scope") or "", module) for r, t in members if r == "constructor"}
    for r, t in types:
        label = "Interface" if r == "interface" else "Class"
        out.append(common | {"record": "type", "label": label, "fqn": t["_fqn"], "name": t["name"], "kind": t["kind"], "visibility": t.get("access") or "public", "is_enum": r == "enum", "is_abstract": False, "is_record": False, "is_final": False, "start_line": t.get("line"), "end_line": t.get("end")})
        if t["kind"] == "class" and t["_fqn"] not in with_ctor:
            out.append(common | {"record": "member", "label": "Method", "owner": t["_fqn"], "owner_kind": "class", "signature": f"{t['_fqn']}.<init>()", "name": "<init>", "kind": "constructor", "is_static": False, "is_synthetic": True, "start_line": 0, "end_line": 0, "visibility": "public"})
    for r, t in members:
        own = owner.get(t.get("scope") or "", module)
        base = common | {"record": "member", "owner": own, "owner_kind": "class", "kind": t["kind"], "visibility": t.get("access") or "public", "type": t.get("typeref") or "", "is_static": bool(t.get("static")), "start_line": t.get("line"), "end_line": t.get("end") or t.get("line")}
        if r in ("method", "constructor"):
            name = "<init>" if r == "constructor" else t["name"]
            out.append(base | {"label": "Method", "signature": f"{own}.{name if r == 'constructor' else encode_tag(name)}({tag_params(t.get('signature'))})", "name": name, "is_synthetic": False})
        else:
            out.append(base | {"label": "Field", "fqn": f"{own}.{encode_tag(t['name'])}", "name": t["name"]})
    return out


def extract(tags: DataFrame) -> DataFrame:
    """Records from tags ``path, language`` and the columns of :data:`TAG`; a file's tags, bounded by the file, are grouped in the JVM."""
    names = [c.split()[0] for c in TAG.split(", ")]
    grouped = tags.groupBy("path", "language").agg(F.to_json(F.sort_array(F.collect_list(F.struct("line", *(n for n in names if n != "line"))))).alias("tags"))

    def run(batches):
        for b in batches:
            for path, language, text in zip(*(c.to_pylist() for c in b.columns)):
                yield batch(records(path, language, json.loads(text)))

    return grouped.select("path", "language", "tags").mapInArrow(run, SCHEMA)
