"""Naming rules: the identities that join records of different files. Python functions for the extractors."""

from __future__ import annotations

import posixpath
import re

LANGUAGES = {"c++": "cpp", "c#": "csharp", "f#": "fsharp", "javascript": "js", "typescript": "js"}
PY_SUFFIXES = (".py", ".pyi", "/__init__.py", "/__init__.pyi")


def language(name: str) -> str:
    """The normal name of a language."""
    low = name.strip().lower()
    return LANGUAGES.get(low, re.sub(r"[^a-z0-9]", "", low))


def encode(segment: str, close: str = "$") -> str:
    """A path segment as an identifier: other characters as ``$hex$``, a leading digit after ``_``."""
    out = "".join(c if c.isascii() and c.isalnum() else f"${ord(c):x}{close}" for c in segment)
    return f"_{out}" if out[:1].isdigit() else out


def encode_tag(segment: str) -> str:
    """The same for tag files: ``_`` stays, the hexadecimal number has no closing sign, blank is ``$default``."""
    if not segment.strip():
        return "$default"
    return "".join(c if c.isalnum() or c == "_" else f"${ord(c):x}" for c in segment)


def module_fqn(prefix: str, path: str) -> str:
    """``python.pkg.service$2e$py`` of ``pkg/service.py``; the same rule with ``js``."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    return ".".join([prefix, *map(encode, parts)])


def package_fqn(prefix: str, path: str) -> str:
    folder = posixpath.dirname(path.replace("\\", "/"))
    return module_fqn(prefix, folder) if folder else prefix


def tag_fqn(lang: str, path: str) -> str:
    return ".".join([lang, *(encode_tag(p) for p in path.replace("\\", "/").split("/") if p not in ("", "."))])


def java_fqn(dotted: str) -> str:
    """``pkg.Outer.Inner`` with nested types joined by ``$``: after the first capitalised segment, further ones are nested."""
    parts = dotted.split(".")
    first = next((i for i, p in enumerate(parts) if p[:1].isupper()), None)
    if first is None:
        return dotted
    last = first
    while last + 1 < len(parts) and parts[last + 1][:1].isupper():
        last += 1
    return ".".join([*parts[:first], "$".join(parts[first : last + 1]), *parts[last + 1 :]])


def signature(owner: str, name: str, params: list[str] | None = None) -> str:
    return f"{owner}.{name}({', '.join(params or [])})"


def tag_params(text: str | None) -> str:
    """The parameters of a tag's signature, each encoded."""
    inner = (text or "").strip().strip("()")
    return ",".join(encode_tag(p.strip()) for p in inner.split(",")) if inner.strip() else ""


def simple_name(fqn: str) -> str:
    return fqn.rpartition(".")[2]


def package_of(fqn: str) -> str:
    return fqn.rpartition(".")[0]
