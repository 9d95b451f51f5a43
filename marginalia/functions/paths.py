"""Vault paths, globs and exclusion rules."""

from __future__ import annotations

import re
import unicodedata
from hashlib import sha256

_KEPT = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~/")


def normalize(path: str) -> str:
    """A vault-relative path with `/` separators and without `.`, `..` and empty parts."""
    if path.startswith(("/", "\\")) or any(unicodedata.category(c) == "Cc" for c in path):
        raise ValueError(f"not a vault-relative path: {path!r}")
    names: list[str] = []
    for name in path.replace("\\", "/").split("/"):
        if name == "..":
            if not names:
                raise ValueError(f"outside the vault: {path!r}")
            names.pop()
        elif name not in ("", "."):
            names.append(name)
    return "/".join(names)


def is_visible(path: str) -> bool:
    return not any(p.startswith(".") for p in re.split(r"[/\\]", path))


def is_markdown(path: str) -> bool:
    stem, dot, ext = path.rsplit("/", 1)[-1].rpartition(".")
    return bool(dot) and bool(stem) and ext.lower() == "md"


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    head, dot, _ = name.rpartition(".")
    return head if dot and head else name


def link_key(target: str) -> str:
    """What links and paths are compared by: composed, lower case, `/` separators, no `.md`."""
    return unicodedata.normalize("NFC", target).lower().replace("\\", "/").removesuffix(".md")


def percent_encode(text: str) -> str:
    return "".join(chr(b) if b in _KEPT else f"%{b:02X}" for b in text.encode())


def glob_regex(pattern: str) -> str:
    """A regular expression (whole path) for a glob: `*` and `?` also cross `/`, `**/` matches no folder too."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.*")
            i += 3
            continue
        if c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise ValueError(f"unclosed class in glob {pattern!r}")
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"dangling escape in glob {pattern!r}")
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob {pattern!r}")
    return "^(?s:" + "".join(out) + ")$"


def exclusion_rules(*sources: list[str]) -> list[str]:
    """Rules of all sources, a trailing `/` standing for all that is below, sorted and without repeats."""
    rules = {r + "**" if r.endswith("/") else r for source in sources for r in source}
    for r in rules:
        glob_regex(r)
    return sorted(rules)


def ignore_lines(content: str) -> list[str]:
    return [x for x in map(str.strip, content.splitlines()) if x and not x.startswith("#")]


def scope_id(root: str, rules: list[str]) -> str:
    """A name for a vault under a set of rules, whatever order they came in."""
    h = sha256()
    for part in (root, *sorted(rules)):
        raw = part.encode()
        h.update(len(raw).to_bytes(8, "little") + raw)
    return h.hexdigest()


def split_subpath(path: str) -> tuple[str, str | None]:
    head, mark, sub = path.partition("#")
    return head, sub if mark else None
